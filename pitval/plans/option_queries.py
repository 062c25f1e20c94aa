"""Option chains: quotes, selection, pricing, moments, strike choice, fees, surface views."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.normal import cdf_sql
from ..operators import options as op
from .bindings import VIEWS, View, view
from .registry import Book

book = Book()
KEY = "symbol snapshot_date:d strike:f tenor_days:i option_type"
KEYS = "symbol, snapshot_date, strike, tenor_days, option_type"


def chain(spark, sf):
    return view(spark, sf, "b_chain")


@book.add("p17_premium", f"{KEY} premium:f multiplier:f", f"""
SELECT {KEYS}, CASE WHEN volume % 2 = 0 THEN (bid + ask) / 2 WHEN tenor_days % 3 = 0 THEN last_price ELSE mid * 0.5 END AS premium,
       CASE WHEN tenor_days % 4 = 0 THEN 10 ELSE 100 END AS multiplier FROM b_chain""")
def premium(spark, sf):
    c = chain(spark, sf)
    ask = F.when(F.col("volume") % 2 == 0, F.col("ask"))
    last = F.when(F.col("tenor_days") % 3 == 0, F.col("last_price"))
    size = F.when(F.col("tenor_days") % 4 == 0, "10").when(F.col("tenor_days") % 5 == 0, "0")
    return c.withColumns({"premium": op.premium(F.col("bid"), ask, last, F.col("mid") * 0.5),
                          "multiplier": op.multiplier(size)})


@book.add("p18_liquidity", f"{KEY} spread_abs:f spread_pct:f oi_volume_ratio:f half_spread_pct:f", f"""
SELECT {KEYS}, ask - bid AS spread_abs, (ask - bid) / ((bid + ask) / 2) AS spread_pct, open_interest / volume AS oi_volume_ratio,
       (ask - bid) / (2 * ((bid + ask) / 2)) * 100 AS half_spread_pct FROM b_chain WHERE tenor_days % 70 <> 0""")
def liquidity(spark, sf):
    c = chain(spark, sf).withColumn("ask", F.when(F.col("tenor_days") % 70 == 0, F.col("bid") * 0.9).otherwise(F.col("ask")))
    return op.half_spreads(op.add_liquidity(c))


@book.add("p19_terms", f"{KEY} days:i moneyness_pct:f log_moneyness:f", f"""
SELECT {KEYS}, expiry - snapshot_date AS days, (strike / spot - 1) * 100 AS moneyness_pct, ln(strike / spot) AS log_moneyness
FROM b_chain""")
def terms(spark, sf):
    return op.add_terms(chain(spark, sf)).withColumn("days", F.col("tenor_days"))


@book.add("p20_sentinels", f"{KEY} last:f", f"""
SELECT {KEYS}, CASE WHEN tenor_days % 30 <> 0 AND volume < 2 THEN last_price END AS last FROM b_chain""")
def sentinels(spark, sf):
    raw = F.when(F.col("tenor_days") % 30 == 0, -1.0).when(F.col("volume") >= 2, float("nan")).otherwise(F.col("last_price"))
    return chain(spark, sf).withColumn("last", op.without_sentinel(raw))


@book.add("p21_candidates", KEY, f"""
SELECT {KEYS} FROM b_chain WHERE tenor_days > 270 AND strike BETWEEN spot * 0.8 AND spot * 1.2""")
def candidate_contracts(spark, sf):
    return op.candidates(chain(spark, sf), 270, 0.2)


@book.add("g16_spread_bands", "band_from:f n:i mean:f median:f p75:f p90:f", """
SELECT CASE WHEN m < 2.5 THEN 0 WHEN m < 5 THEN 2.5 WHEN m < 10 THEN 5 WHEN m < 20 THEN 10 ELSE 20 END AS band_from,
       count(*) AS n, avg(mid) AS mean, median(mid) AS median, quantile_cont(mid, 0.75) AS p75, quantile_cont(mid, 0.9) AS p90
FROM (SELECT *, abs(moneyness_pct) AS m FROM b_chain) c WHERE m < 100 GROUP BY 1""")
def spread_bands(spark, sf):
    return op.banded(chain(spark, sf).withColumn("m", F.abs("moneyness_pct")), "mid", "m", dims.MONEYNESS_BANDS)


VIEWS["b_requests"] = View("""
SELECT event_id, concat('Brand#', CAST(1 + user_id % 25 AS VARCHAR(20))) AS symbol,
       CASE WHEN gap_pct > 0 THEN 'CALL' ELSE 'PUT' END AS option_type,
       make_date(CAST(1993 + event_id % 7 AS INT), CAST(1 + event_id % 12 AS INT), CAST(1 + event_id % 28 AS INT)) AS as_of,
       CASE WHEN event_id % 10 = 0 THEN CAST(NULL AS DOUBLE)
            ELSE 950 * (CAST(0.75 AS DOUBLE) + CAST(event_id % 50 AS DOUBLE) / 97) END AS target_strike
FROM {b_signals}""")
VIEWS["b_snapshot_of"] = View("""
SELECT r.*, CASE WHEN r.as_of - s.sd <= 14 THEN s.sd END AS snapshot_date
FROM b_requests r ASOF LEFT JOIN (SELECT DISTINCT symbol, option_type, snapshot_date AS sd FROM b_chain) s
  ON s.symbol = r.symbol AND s.option_type = r.option_type AND r.as_of >= s.sd""")


@book.add("j12_nearest_contract", "event_id:i symbol option_type as_of:d snapshot_date:d strike:f tenor_days:i mid:f", """
SELECT r.event_id, r.symbol, r.option_type, r.as_of, r.snapshot_date, c.strike, c.tenor_days, c.mid
FROM b_snapshot_of r LEFT JOIN LATERAL (
  SELECT * FROM b_chain c WHERE c.symbol = r.symbol AND c.option_type = r.option_type AND c.snapshot_date = r.snapshot_date
  ORDER BY CASE WHEN r.target_strike IS NULL THEN abs(c.moneyness_pct) ELSE abs(c.strike - r.target_strike) END,
           abs(c.tenor_days - 730), c.strike, c.tenor_days LIMIT 1) c ON TRUE""")
def nearest(spark, sf):
    return op.nearest_contract(view(spark, sf, "b_requests"), chain(spark, sf), ["mid"])


@book.add("j13_quoted_strikes", "event_id:i n:i strikes", """
SELECT r.event_id, count(DISTINCT c.strike) AS n, nullif(coalesce(string_agg(DISTINCT CAST(floor(c.strike + 0.5) AS BIGINT)::VARCHAR, ','
       ORDER BY CAST(floor(c.strike + 0.5) AS BIGINT)::VARCHAR), ''), '') AS strikes
FROM b_snapshot_of r LEFT JOIN (SELECT *, min(abs(tenor_days - 730)) OVER (PARTITION BY symbol, option_type, snapshot_date) AS best
     FROM b_chain) c ON c.symbol = r.symbol AND c.option_type = r.option_type AND c.snapshot_date = r.snapshot_date
     AND abs(c.tenor_days - 730) = c.best GROUP BY r.event_id""")
def quoted(spark, sf):
    q = op.quoted_strikes(view(spark, sf, "b_requests"), chain(spark, sf))
    text = F.array_sort(F.transform("strikes", lambda k: F.floor(k + 0.5).cast("string")))
    return q.select("event_id", F.coalesce(F.size("strikes"), F.lit(0)).alias("n"), F.concat_ws(",", text).alias("t")) \
        .withColumn("strikes", F.when(F.col("n") > 0, F.col("t")))


@book.add("j13_listed_strikes", "event_id:i snapshot_date:d rung:i strike:f", """
SELECT DISTINCT r.event_id, r.snapshot_date, c.strike, c.rung FROM b_snapshot_of r JOIN (
  SELECT *, dense_rank() OVER (PARTITION BY symbol, option_type, snapshot_date ORDER BY strike) AS rung FROM (
    SELECT *, min(abs(tenor_days - 730)) OVER (PARTITION BY symbol, option_type, snapshot_date) AS best FROM b_chain) x
  WHERE strike > 0 AND abs(tenor_days - 730) = best) c
 ON c.symbol = r.symbol AND c.option_type = r.option_type AND c.snapshot_date = r.snapshot_date""")
def listed(spark, sf):
    return op.listed_strikes(view(spark, sf, "b_requests"), chain(spark, sf))


@book.add("j11_match_contracts", f"{KEY} bid:f iv:f iv_source", f"""
SELECT {KEYS}, CASE WHEN tenor_days % 3 = 0 OR tenor_days % 7 <> 0 THEN bid END AS bid,
       CASE WHEN volume = 1 OR tenor_days % 7 <> 0 THEN iv END AS iv,
       CASE WHEN volume = 1 THEN 'primary' WHEN tenor_days % 7 <> 0 THEN 'secondary' END AS iv_source FROM b_chain""")
def matched(spark, sf):
    c = chain(spark, sf)
    left = c.withColumns({"bid": F.when(F.col("tenor_days") % 3 == 0, F.col("bid")), "iv": F.when(F.col("volume") == 1, F.col("iv"))})
    right = c.where("tenor_days % 7 <> 0").withColumn("strike", F.col("strike") + 4e-7)
    return op.match_contracts(left, right, ["symbol", "snapshot_date", "tenor_days", "option_type"], ["bid", "iv"])


# pricing terms shared by the oracles below
RATE, YIELD = 0.04, 0.018
VIEWS["b_terms"] = View(f"""
SELECT *, sg * d1 AS z1, sg * (d1 - sd) AS z2, spot * exp(-{YIELD} * t) AS ds, strike * exp(-{RATE} * t) AS dk,
       exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS p1
FROM (SELECT *, (ln(spot / strike) + ({RATE} - {YIELD} + iv * iv / 2) * t) / sd AS d1
      FROM (SELECT *, tenor_days / 365.0::DOUBLE AS t, iv * sqrt(tenor_days / 365.0::DOUBLE) AS sd,
                   CASE WHEN option_type = 'CALL' THEN 1 ELSE -1 END AS sg FROM b_chain) a) b""")
VIEWS["b_cdf"] = View(f"SELECT *, {cdf_sql('z1')} AS n1, {cdf_sql('z2')} AS n2 FROM b_terms")
VIEWS["b_greeks"] = View(f"""
SELECT *, sg * (ds * n1 - dk * n2) AS price, sg * exp(-{YIELD} * t) * n1 AS delta, exp(-{YIELD} * t) * p1 / (spot * sd) AS gamma,
       ds * p1 * sqrt(t) / 100 AS vega,
       (-ds * p1 * iv / (2 * sqrt(t)) + sg * ({YIELD} * ds * n1 - {RATE} * dk * n2)) / 365 AS theta FROM b_cdf""")


def priced_chain(spark, sf):
    c = chain(spark, sf).withColumns({"t": F.col("tenor_days") / 365.0, "r": F.lit(RATE), "q": F.lit(YIELD)})
    return op.price_and_greeks(c)


@book.add("f9_price_and_greeks", f"{KEY} price:f delta:f6 gamma:f8 vega:f6 theta:f6",
          f"SELECT {KEYS}, price, delta, gamma, vega, theta FROM b_greeks")
def price_and_greeks(spark, sf):
    return priced_chain(spark, sf)


@book.add("g17_book_greeks", "snapshot_date:d delta_notional:f0 theta_per_day:f0 vega_notional:f0", """
SELECT snapshot_date, sum(abs(delta) * spot * open_interest * 100) AS delta_notional, sum(theta * open_interest * 100) AS theta_per_day,
       sum(vega * open_interest * 100) AS vega_notional FROM b_greeks GROUP BY 1""")
def book_greeks(spark, sf):
    return op.portfolio_greeks(priced_chain(spark, sf), ["snapshot_date"], F.col("open_interest") * 100)


VIEWS["b_flat"] = View(f"""
SELECT *, sg * (spot * n1 - dk * n2) AS price0, spot * exp(-e1 * e1 / 2) / sqrt(2 * pi()) * sqrt(t) / 100 AS vega0
FROM (SELECT *, {cdf_sql('(sg * e1)')} AS n1, {cdf_sql('(sg * (e1 - sd))')} AS n2
      FROM (SELECT * EXCLUDE (z1, z2, p1, d1), (ln(spot / strike) + ({RATE} + iv * iv / 2) * t) / sd AS e1 FROM b_terms) a) b""")


@book.add("f10_implied_vol_round_trip", f"{KEY} implied_vol:f iv_source", f"""
SELECT {KEYS}, iv AS implied_vol, CASE WHEN volume > 1 THEN 'quoted' ELSE 'estimated' END AS iv_source FROM b_flat
WHERE vega0 > 0.1 AND price0 >= greatest(0, sg * (spot - strike))""")
def implied_vol(spark, sf):
    c = chain(spark, sf).withColumns({"t": F.col("tenor_days") / 365.0, "r": F.lit(RATE), "q": F.lit(0.0)})
    c = op.price_and_greeks(c)
    sign = F.when(F.col("option_type") == "CALL", 1.0).otherwise(-1.0)
    c = c.where((F.col("vega") > 0.1) & (F.col("price") >= F.greatest(F.lit(0.0), sign * (F.col("spot") - F.col("strike")))))
    c = c.withColumn("iv", F.when(F.col("volume") > 1, F.col("iv")))
    return op.enrich_iv(c, "price").withColumn("implied_vol", F.col("iv"))


VIEWS["b_moment_terms"] = View("""
SELECT *, spot * exp(mu * t) AS m1, spot * spot * exp((2 * mu + v * v) * t) AS m2, v * sqrt(t) AS s, strike + sg * premium AS b
FROM (SELECT *, tenor_days / 365.0::DOUBLE AS t, iv AS v, mid AS premium, CASE WHEN option_type = 'CALL' THEN 1 ELSE -1 END AS sg,
             0.8 * ln((spot * 1.1) / spot) / (tenor_days / 365.0::DOUBLE) AS mu FROM b_chain) a""")
VIEWS["b_moment_z"] = View("""
SELECT *, (ln(spot / strike) + (mu + v * v / 2) * t) / s AS zk, s - (ln(spot / strike) + (mu + v * v / 2) * t) / s AS wk,
       (ln(spot / b) + (mu + v * v / 2) * t) / s AS zb, s - (ln(spot / b) + (mu + v * v / 2) * t) / s AS wb FROM b_moment_terms""")
VIEWS["b_moment_parts"] = View(f"""
SELECT *, {cdf_sql('wk')} AS pk, m1 * {cdf_sql('(-zk)')} AS ek, m2 * {cdf_sql('(-(zk + s))')} AS sk,
       {cdf_sql('wb')} AS pb, m1 * {cdf_sql('(-zb)')} AS eb, m2 * {cdf_sql('(-(zb + s))')} AS sb FROM b_moment_z""")
VIEWS["b_moments"] = View("""
SELECT *, sqrt(greatest(0, second - mean * mean)) AS sd,
       sqrt(greatest(0, premium * premium * CASE WHEN sg = 1 THEN pk ELSE 1 - pk END
            + sg * (b * b * (pb - pk) - 2 * b * (eb - ek) + (sb - sk)))) AS down, CASE WHEN sg = 1 THEN 1 - pb ELSE pb END AS pop
FROM (SELECT *, CASE WHEN sg = 1 THEN m1 - ek - strike * (1 - pk) ELSE strike * pk - ek END AS mean,
             CASE WHEN sg = 1 THEN (m2 - sk) - 2 * strike * (m1 - ek) + strike * strike * (1 - pk)
                  ELSE strike * strike * pk - 2 * strike * ek + sk END AS second FROM b_moment_parts) a""")


def moment_rows(spark, sf):
    t = F.col("tenor_days") / 365.0
    c = chain(spark, sf).withColumns({"t": t, "sigma": F.col("iv"), "premium": F.col("mid")})
    return c.withColumn("mu", op.convergence_drift(F.col("spot") * 1.1, F.col("spot"), F.col("t"), 0.8))


@book.add("f11_payoff_moments", f"{KEY} expected_payoff:f2 std_payoff:f2 downside_semideviation:f2 probability_of_profit:f sharpe:f", f"""
SELECT {KEYS}, mean AS expected_payoff, sd AS std_payoff, down AS downside_semideviation, pop AS probability_of_profit,
       CASE WHEN sd > 1 THEN (mean - premium) / sd END AS sharpe FROM b_moments""")
def payoff_moments(spark, sf):
    return op.payoff_moments(moment_rows(spark, sf)).withColumn("sharpe", F.when(F.col("std_payoff") > 1, F.col("sharpe")))


@book.add("f13_convergence_drift", f"{KEY} mu:f6", f"SELECT {KEYS}, mu FROM b_moment_terms")
def drift(spark, sf):
    return moment_rows(spark, sf)


@book.add("f15_strike_target", "event_id:i target:f", """
SELECT event_id, CASE WHEN CASE WHEN event_id % 3 = 0 THEN 0.9 * 950 WHEN event_id % 3 = 1 THEN (gap_pct * 20 + 950) / 2 END > 0
       THEN CASE WHEN event_id % 3 = 0 THEN 0.9 * 950 WHEN event_id % 3 = 1 THEN (gap_pct * 20 + 950) / 2 END END AS target
FROM b_signals""")
def strike_target(spark, sf):
    third = F.col("event_id") % 3
    t = op.strike_target(F.when(third == 0, 0.9), F.when(third == 1, F.col("gap_pct") * 20), F.lit(950.0))
    return view(spark, sf, "b_signals").withColumn("target", t)


@book.add("f14_volatility_choice", "event_id:i sigma:f vol_source", """
SELECT r.event_id, CASE WHEN i.iv > 0 THEN greatest(0.12, least(0.45, i.iv)) WHEN r.event_id % 4 > 0
       THEN greatest(0.12, least(0.45, (r.event_id % 60) / 100.0::DOUBLE + 0.01)) ELSE 0.30 END AS sigma,
       CASE WHEN i.iv > 0 THEN 'implied' WHEN r.event_id % 4 > 0 THEN 'realized' ELSE 'constant' END AS vol_source
FROM b_snapshot_of r LEFT JOIN LATERAL (SELECT iv FROM b_chain c WHERE c.symbol = r.symbol AND c.option_type = r.option_type
     AND c.snapshot_date = r.snapshot_date ORDER BY abs(c.moneyness_pct), abs(c.tenor_days - 730), c.strike, c.tenor_days LIMIT 1) i ON TRUE""")
def volatility_choice(spark, sf):
    req = view(spark, sf, "b_requests").withColumn("target_strike", F.lit(None).cast("double"))
    found = op.nearest_contract(req, chain(spark, sf), ["iv"])
    realized = F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 60) / 100.0 + 0.01)
    value, label = op.volatility_choice(F.col("iv"), realized, 0.12, 0.45)
    return found.withColumns({"sigma": value, "vol_source": label})


def selection_rows(spark, sf, criterion):
    base = chain(spark, sf).groupBy("symbol", "snapshot_date", "option_type").agg(
        F.avg("iv").alias("sigma"), F.avg("moneyness_pct").alias("lean"), F.max("spot").alias("spot"))
    value = F.col("spot") * (1 + F.when(F.col("option_type") == "CALL", 0.25).otherwise(-0.25) + F.col("lean") / 1000)
    base = base.withColumn("t", F.lit(730 / 365.0)).withColumns({
        "mu": op.convergence_drift(value, F.col("spot"), F.col("t"), 0.8), "r": F.lit(RATE), "q": F.lit(YIELD)})
    c = op.price_and_greeks(op.strike_grid(base), vol="sigma").withColumnRenamed("price", "premium")
    return op.best_strike(c, ["symbol", "snapshot_date", "option_type"], criterion)


@book.add("f12_kelly_strike", "symbol snapshot_date:d option_type n_candidates:i n_negative_edge:i strike:f2 kelly_fraction:f score:f6 edge:f2")
def kelly_strike(spark, sf):
    return selection_rows(spark, sf, "kelly")


VIEWS["b_grid"] = View(f"""
SELECT *, spot * exp(k * 0.25 * sigma * sqrt(2.0)) AS strike
FROM (SELECT symbol, snapshot_date, option_type, avg(iv) AS sigma, avg(moneyness_pct) AS lean, 950::DOUBLE AS spot, 2.0::DOUBLE AS t,
             CASE WHEN option_type = 'CALL' THEN 1 ELSE -1 END AS sg FROM b_chain GROUP BY 1, 2, 3) a
CROSS JOIN (SELECT unnest(range(-12, 13)) AS k) g""")
VIEWS["b_grid_terms"] = View(f"""
SELECT *, (ln(spot / strike) + ({RATE} - {YIELD} + sigma * sigma / 2) * t) / s AS d1, (ln(spot / strike) + (mu + sigma * sigma / 2) * t) / s AS zk
FROM (SELECT *, sigma * sqrt(t) AS s, 0.8 * ln((1 + sg * 0.25 + lean / 1000)) / t AS mu FROM b_grid) a""")
VIEWS["b_grid_cdf"] = View(f"""
SELECT *, {cdf_sql('(sg * d1)')} AS n1, {cdf_sql('(sg * (d1 - s))')} AS n2, {cdf_sql('(sg * zk)')} AS c1, {cdf_sql('(sg * (zk - s))')} AS c2,
       {cdf_sql('(sg * (zk + s))')} AS c3 FROM b_grid_terms""")
VIEWS["b_grid_edge"] = View(f"""
SELECT *, mean - premium AS edge, (mean - premium) / sqrt(second - mean * mean) AS sharpe
FROM (SELECT *, sg * (spot * exp(-{YIELD} * t) * n1 - strike * exp(-{RATE} * t) * n2) AS premium,
             sg * (spot * exp(mu * t) * c1 - strike * c2) AS mean,
             spot * spot * exp((2 * mu + sigma * sigma) * t) * c3 - 2 * strike * spot * exp(mu * t) * c1 + strike * strike * c2 AS second
      FROM b_grid_cdf) a""")


@book.add("f12_sharpe_strike", "symbol snapshot_date:d option_type n_candidates:i n_negative_edge:i strike:f2 score:f", """
SELECT symbol, snapshot_date, option_type, count(*) AS n_candidates, count(*) FILTER (premium > 0 AND edge <= 0) AS n_negative_edge,
       max_by(strike, sharpe) FILTER (premium > 0 AND edge > 0) AS strike, max(sharpe) FILTER (premium > 0 AND edge > 0) AS score
FROM b_grid_edge GROUP BY 1, 2, 3""")
def sharpe_strike(spark, sf):
    return selection_rows(spark, sf, "sharpe")


VIEWS["b_fills"] = View("""
SELECT run_id, date, symbol, side, option_type, contracts, price / 100000 AS price, multiplier FROM b_exec""")
VIEWS["b_fill_volume"] = View("""
SELECT *, sum(contracts) OVER (PARTITION BY run_id, date_trunc('month', date) ORDER BY date, symbol, side, option_type, contracts, price
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - contracts AS vol FROM b_fills""")


@book.add("f16_order_fees", "run_id date:d symbol side option_type contracts:f price:f6 monthly_contracts:f commission_rate:f fees:f", """
SELECT run_id, date, symbol, side, option_type, contracts, price, vol AS monthly_contracts, rate AS commission_rate,
       greatest(contracts * rate, 1) + contracts * (0.02295::DOUBLE + 0.0003::DOUBLE + 0.025::DOUBLE)
       + CASE WHEN side = 'sell' THEN contracts * 0.00329::DOUBLE + contracts * multiplier * price * 0.0000206::DOUBLE ELSE 0 END AS fees
FROM (SELECT *, CASE WHEN vol <= 10000 THEN CASE WHEN price < 0.05 THEN 0.25 WHEN price < 0.10 THEN 0.5 ELSE 0.65 END
             WHEN vol <= 50000 THEN CASE WHEN price < 0.05 THEN 0.25 ELSE 0.5 END WHEN vol <= 100000 THEN 0.25 ELSE 0.15 END AS rate
      FROM b_fill_volume) f""")
def order_fees(spark, sf):
    fills = view(spark, sf, "b_exec").withColumn("price", F.col("price") / 100000)
    return op.order_fees(fills, ["run_id"], ["date", "symbol", "side", "option_type", "contracts", "price"])


VIEWS["b_orders"] = View("""
SELECT run_id, entry_date AS date, symbol, contracts, entry_price, CASE WHEN exit_reason LIKE 'N%' THEN 0 ELSE contracts * entry_price END AS target_dollar,
       CASE WHEN contracts > 45 THEN CAST(NULL AS VARCHAR(4)) ELSE option_type END AS option_type
FROM {b_trades}""")
VIEWS["b_lanes"] = View("""
SELECT *, row_number() OVER (PARTITION BY run_id, date, lane ORDER BY CASE WHEN lane IN ('CALL', 'PUT') THEN -target_dollar ELSE 0 END,
       symbol, contracts, entry_price) AS rank
FROM (SELECT *, CASE WHEN target_dollar <= 0 THEN 'sell' WHEN option_type IS NOT NULL THEN option_type ELSE 'other' END AS lane FROM b_orders) a""")


@book.add("w21_execution_order", "run_id date:d symbol lane rank:i position:i target_dollar:f", """
SELECT run_id, date, symbol, lane, rank, target_dollar, row_number() OVER (PARTITION BY run_id, date
  ORDER BY CASE lane WHEN 'sell' THEN 0 WHEN 'other' THEN 2 ELSE 1 END, rank, lane) AS position FROM b_lanes""")
def execution_order(spark, sf):
    return op.interleaved(view(spark, sf, "b_orders"), ["run_id", "date"], "target_dollar", ["symbol", "contracts", "entry_price"])


@book.add("m17_atm_term_structure", "symbol snapshot_date:d expiry:d tenor_days:i strike:f iv:f6", """
SELECT symbol, snapshot_date, expiry, min_by(tenor_days, k) AS tenor_days, min_by(strike, k) AS strike, min_by(iv, k) AS iv
FROM (SELECT *, (abs(moneyness_pct), strike, option_type) AS k FROM b_chain) c GROUP BY 1, 2, 3""")
def term_structure(spark, sf):
    return op.atm_term_structure(chain(spark, sf))


@book.add("m17_put_call_skew", "symbol snapshot_date:d expiry:d skew_put_call:f6 volume_ratio:f", """
SELECT symbol, snapshot_date, expiry, avg(iv) FILTER (option_type = 'PUT' AND moneyness_pct BETWEEN -30 AND -15)
       - avg(iv) FILTER (option_type = 'CALL' AND moneyness_pct BETWEEN 15 AND 30) AS skew_put_call,
       coalesce(sum(volume) FILTER (option_type = 'PUT'), 0) / nullif(sum(volume) FILTER (option_type = 'CALL'), 0) AS volume_ratio
FROM b_chain GROUP BY 1, 2, 3""")
def skew(spark, sf):
    return op.put_call_skew(chain(spark, sf))


VIEWS["b_surface_span"] = View("""
SELECT symbol, count(*) AS n, min(ln(strike / spot)) AS x0, max(ln(strike / spot)) AS x1, min(tenor_days) AS y0, max(tenor_days) AS y1,
       stddev_pop(ln(strike / spot)) AS sx, stddev_pop(tenor_days) AS sy FROM b_chain GROUP BY 1 HAVING count(*) >= 5""")


@book.add("m18_smooth_surface", "symbol grid_x:i grid_y:i log_moneyness:f days:f iv:f iv_std:f", """
SELECT symbol, grid_x, grid_y, min(gx) AS log_moneyness, min(gy) AS days, sum(w * iv) / sum(w) AS iv,
       sqrt(greatest(0, sum(w * iv * iv) / sum(w) - pow(sum(w * iv) / sum(w), 2))) AS iv_std
FROM (SELECT *, exp(-(pow((lm - gx) / (sx + 1e-9), 2) + pow((tenor_days - gy) / (sy + 1e-9), 2)) / (2 * 0.35 * 0.35)) AS w
      FROM (SELECT c.symbol, c.iv, c.tenor_days, ln(strike / spot) AS lm, sx, sy, i.i AS grid_x, j.i AS grid_y,
                   x0 + (x1 - x0) * i.i / 3 AS gx, y0 + (y1 - y0) * j.i / 3 AS gy
            FROM b_chain c JOIN b_surface_span s USING (symbol), (SELECT unnest(range(4)) AS i) i, (SELECT unnest(range(4)) AS i) j) a) b
GROUP BY 1, 2, 3""")
def surface(spark, sf):
    return op.smooth_surface(op.add_terms(chain(spark, sf)), ["symbol"], points=4)


@book.add("m19_liquidity_anomalies", f"{KEY} anomaly_score:f is_anomaly:b", f"""
SELECT {KEYS}, score AS anomaly_score, n >= 10 AND score > quantile_cont(score, 0.95) OVER (PARTITION BY symbol, option_type) AS is_anomaly
FROM (SELECT *, count(*) OVER w AS n, sqrt(coalesce(pow((volume - avg(volume) OVER w) / nullif(stddev_pop(volume) OVER w, 0), 2), 0)
             + coalesce(pow((open_interest - avg(open_interest) OVER w) / nullif(stddev_pop(open_interest) OVER w, 0), 2), 0)
             + coalesce(pow((moneyness_pct - avg(moneyness_pct) OVER w) / nullif(stddev_pop(moneyness_pct) OVER w, 0), 2), 0)) AS score
      FROM b_chain WINDOW w AS (PARTITION BY symbol, option_type)) s""")
def anomalies(spark, sf):
    return op.flag_anomalies(chain(spark, sf), ["symbol", "option_type"], ["volume", "open_interest", "moneyness_pct"])


VIEWS["d_yields"] = View("SELECT * FROM (VALUES ('BUILDING', 0.035::DOUBLE), ('MACHINERY', 0.012::DOUBLE)) AS y(sector, dividend_yield)")


@book.add("p13_carry_terms", "symbol fiscal_year:i r:f6 q:f6", """
SELECT f.symbol, f.fiscal_year, coalesce(r.rate, 0.04) AS r, coalesce(y.dividend_yield, 0.018) AS q
FROM b_financials f LEFT JOIN d_rates r ON r.year = year(f.filed_date) - 1 LEFT JOIN d_yields y USING (sector)""")
def carry_terms(spark, sf):
    from .valuation_queries import TEST_RATES
    yields = dims.dividend_yields(spark, {"BUILDING": 0.035, "MACHINERY": 0.012})
    return op.add_carry(view(spark, sf, "b_financials"), dims.rates(spark, TEST_RATES), yields, "filed_date")


@book.add("m17_iv_source_mix", "iv_source n:i", """
SELECT CASE WHEN volume = 1 THEN 'primary' WHEN tenor_days % 7 <> 0 THEN 'secondary' ELSE 'none' END AS iv_source, count(*) AS n
FROM b_chain GROUP BY 1""")
def iv_source_mix(spark, sf):
    from ..operators.signals import diagnostics
    return diagnostics(matched(spark, sf), "iv_source")
