"""Eligibility, weights, strategies, sweeps."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..session import cut
from ..operators import signals as sg
from .bindings import VIEWS, View, view
from .join_queries import grid, membership_spans
from .registry import Book

book = Book()


def water_fill(source: str, keys: str, conviction: str, order: str, cap: float = 0.2) -> str:
    """The closed form of capped weights as SQL over a whole group."""
    return f"""
SELECT w.*, CASE WHEN total <= 0 THEN {conviction} WHEN n * {cap} <= 1 + 1e-12 THEN {cap}
            ELSE least({cap}, {conviction} * scale) END AS weight
FROM (SELECT *, min_by(CASE WHEN s * {conviction} <= {cap} THEN s END, CASE WHEN s * {conviction} <= {cap} THEN k END)
             OVER (PARTITION BY {keys}) AS scale
      FROM (SELECT *, (1 - k * {cap}) / nullif(total - above, 0) AS s
            FROM (SELECT *, row_number() OVER o - 1 AS k, sum({conviction}) OVER (PARTITION BY {keys}) AS total,
                         count(*) OVER (PARTITION BY {keys}) AS n, coalesce(sum({conviction}) OVER (PARTITION BY {keys}
                         ORDER BY {conviction} DESC, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
                  FROM {source} WINDOW o AS (PARTITION BY {keys} ORDER BY {conviction} DESC, {order})) a) b) w"""


VIEWS["b_candidates"] = View("SELECT *, abs(gap_pct) AS conviction FROM b_signals WHERE abs(gap_pct) >= 20")
VIEWS["b_weights"] = View(water_fill("b_candidates", "published_date", "conviction", "event_id", 0.02))


def candidate_weights(spark, sf):
    c = view(spark, sf, "b_signals").withColumn("conviction", F.abs("gap_pct")).where("conviction >= 20")
    return sg.capped_weights(c, ["published_date"], "conviction", "event_id", 2.0)


@book.add("w1_capped_weights", "event_id:i published_date:d weight:f8",
          "SELECT event_id, published_date, weight FROM b_weights")
def capped(spark, sf):
    return candidate_weights(spark, sf)


@book.add("w2_sector_cap", "event_id:i sector weight:f8", """
SELECT event_id, sector, weight * least(1, 0.15 / sum(weight) OVER (PARTITION BY published_date, sector)) AS weight
FROM b_weights""")
def sector_cap(spark, sf):
    return sg.cap_by_group(candidate_weights(spark, sf), ["published_date"], "sector", cap_pct=15.0)


@book.add("w3_sector_baseline", "event_id:i baseline:f excess:f", """
SELECT event_id, b AS baseline, gap_pct - b AS excess
FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY published_date, sector) >= 5
      THEN median(gap_pct) OVER (PARTITION BY published_date, sector)
      ELSE median(gap_pct) OVER (PARTITION BY published_date) END AS b FROM b_signals) s""")
def sector_baseline(spark, sf):
    return sg.group_baseline(view(spark, sf, "b_signals"), ["published_date"], "sector", "gap_pct")


@book.add("p9_inflation_adjusted", "event_id:i adjusted_gap:f adjusted_log:f", """
SELECT event_id, ((1 + gap_pct / 100) * pow(1 + 4.12 / 100, 2) - 1) * 100 AS adjusted_gap,
       gap_pct + ln(1 + 4.12 / 100) * 2 * 100 AS adjusted_log FROM b_signals""")
def inflation_adjusted(spark, sf):
    s = sg.inflation_adjusted(view(spark, sf, "b_signals"), dims.inflation(spark), "gap_pct", "published_date", 2.0)
    return sg.inflation_adjusted(s, dims.inflation(spark), "gap_pct", "published_date", 2.0, log=True, out="adjusted_log")


@book.add("m13_threshold_sweep", "threshold:f candidates:i groups:i avg_candidates:f avg_invested:f max_weight:f6", f"""
SELECT threshold, sum(n) AS candidates, count(*) AS groups, avg(n) AS avg_candidates, avg(invested) AS avg_invested,
       max(top) AS max_weight
FROM (SELECT threshold, published_date, count(*) AS n, sum(weight) AS invested, max(weight) AS top
      FROM ({water_fill("(SELECT *, abs(gap_pct) AS size FROM b_signals CROSS JOIN (VALUES (10.0::DOUBLE), (20.0), (40.0), (300.0)) t(threshold) WHERE abs(gap_pct) >= threshold) x", "threshold, published_date", "size", "event_id", 0.05)}) y
      GROUP BY 1, 2) z GROUP BY 1""")
def sweep(spark, sf):
    return sg.threshold_sweep(view(spark, sf, "b_signals"), ["published_date"], "gap_pct", "event_id",
                              [10.0, 20.0, 40.0, 300.0], 5.0)


VIEWS["b_momentum"] = View("""
SELECT concat('U', CAST(user_id AS VARCHAR(20))) AS symbol, CAST(ts AS DATE) AS date, (avg(value) - 60) / 200 AS momentum
FROM {events} WHERE event_type = 'view' GROUP BY user_id, CAST(ts AS DATE)""")
VIEWS["b_known_full"] = View("""
SELECT g.ticker AS symbol, g.date, s.* EXCLUDE (symbol)
FROM b_asof_grid g ASOF JOIN (SELECT * FROM b_signals s WHERE event_id = (SELECT max(event_id) FROM b_signals t
       WHERE t.symbol = s.symbol AND t.published_date = s.published_date)) s
  ON s.symbol = g.ticker AND g.date >= s.published_date""")
VIEWS["b_usable"] = View("""
SELECT k.*, m.momentum FROM b_known_full k LEFT JOIN b_momentum m ON m.symbol = k.symbol AND m.date = k.date
WHERE k.date - k.published_date <= CASE k.period_type WHEN 'FY' THEN 270 WHEN 'TTM' THEN 120 ELSE 400 END
 AND EXISTS (SELECT 1 FROM b_spans s WHERE s.ticker = k.symbol AND (s.start_date IS NULL OR s.start_date <= k.date)
             AND (s.end_date IS NULL OR s.end_date > k.date))
 AND NOT EXISTS (SELECT 1 FROM b_material x WHERE x.symbol = k.symbol AND coalesce(x.materiality, FALSE)
             AND x.filed_date > k.published_date AND x.filed_date <= k.date)
""")
VIEWS["b_eligible"] = View("""
SELECT * EXCLUDE (momentum) FROM b_usable WHERE momentum IS NULL OR momentum * 100 >= -10 OR user_id % 10 = 0""")
VIEWS["b_eligible_oriented"] = View("""
SELECT * EXCLUDE (momentum) FROM b_usable WHERE user_id % 10 = 0 OR
 CASE WHEN momentum IS NULL OR gap_pct IS NULL OR gap_pct = 0 THEN TRUE
      WHEN gap_pct > 0 THEN momentum * 100 >= -10 ELSE momentum * 100 <= 10 END""")


def eligible_signals(spark, sf, oriented=False):
    g = grid(spark, sf).withColumnRenamed("ticker", "symbol")
    held = g.where("cast(substr(symbol, 2) as int) % 10 = 0")
    material = view(spark, sf, "b_material").where("coalesce(materiality, false)")
    return sg.eligible(g, view(spark, sf, "b_signals"), membership_spans(spark, sf).withColumnRenamed("ticker", "symbol"),
                       material, view(spark, sf, "b_momentum"), held, oriented=oriented)


@book.add("m15_oriented_eligible_signals", "symbol date:d event_id:i published_date:d period_type gap_pct:f",
          "SELECT symbol, date, event_id, published_date, period_type, gap_pct FROM b_eligible_oriented")
def eligible_oriented(spark, sf):
    return eligible_signals(spark, sf, oriented=True)


@book.add("m15_eligible_signals", "symbol date:d event_id:i published_date:d period_type gap_pct:f",
          "SELECT symbol, date, event_id, published_date, period_type, gap_pct FROM b_eligible")
def eligible(spark, sf):
    return eligible_signals(spark, sf)


VIEWS["b_adjusted"] = View("""
SELECT *, ((1 + gap_pct / 100) * (1 + 4.12 / 100) - 1) * 100 AS adjusted_gap FROM b_eligible""")
VIEWS["b_long_rows"] = View("SELECT * FROM b_adjusted WHERE adjusted_gap >= 20")


@book.add("m16_long_only_weights", "symbol date:d adjusted_gap:f weight:f6", f"""
SELECT symbol, date, adjusted_gap, weight FROM ({water_fill("b_long_rows", "date", "adjusted_gap", "symbol", 0.2)}) w""")
def long_only(spark, sf):
    return sg.STRATEGIES["valuation_gap"](eligible_signals(spark, sf), dims.inflation(spark))


VIEWS["b_neutral_rows"] = View("""
SELECT * FROM (SELECT *, adjusted_gap - CASE WHEN count(*) OVER (PARTITION BY date, sector) >= 5
       THEN median(adjusted_gap) OVER (PARTITION BY date, sector) ELSE median(adjusted_gap) OVER (PARTITION BY date) END AS excess
FROM b_adjusted) a WHERE excess >= 10 AND adjusted_gap >= 10""")


@book.add("m16_sector_neutral_weights", "symbol date:d sector excess:f weight:f6", f"""
SELECT symbol, date, sector, excess, weight * least(1, 0.3 / sum(weight) OVER (PARTITION BY date, sector)) AS weight
FROM ({water_fill("b_neutral_rows", "date", "excess", "symbol", 0.2)}) w""")
def neutral(spark, sf):
    return sg.STRATEGIES["sector_neutral"](eligible_signals(spark, sf), dims.inflation(spark))


VIEWS["b_option_rows"] = View("""
SELECT *, least(abs(g), 100) AS conviction FROM (SELECT *, ln(theoretical / close) * 100 + ln(1 + 4.12 / 100) * (730 / 365.0) * 100 AS g
FROM b_eligible_oriented WHERE theoretical > 0) a WHERE abs(g) >= 20""")


@book.add("m16_option_targets", "symbol date:d direction enter:b weight:f6", f"""
SELECT k.symbol, k.date, CASE WHEN k.g > 0 THEN 'CALL' ELSE 'PUT' END AS direction, abs(k.g) >= 20 AS enter, w.weight
FROM (SELECT *, ln(theoretical / close) * 100 + ln(1 + 4.12 / 100) * (730 / 365.0) * 100 AS g
      FROM b_eligible_oriented WHERE theoretical > 0) k
LEFT JOIN ({water_fill("b_option_rows", "date", "conviction", "symbol", 0.2)}) w ON w.symbol = k.symbol AND w.date = k.date
WHERE abs(k.g) >= 14""")
def option_targets(spark, sf):
    return sg.STRATEGIES["option_gap"](eligible_signals(spark, sf, oriented=True), dims.inflation(spark))


@book.add("u5_diagnostics", "period_type n:i", "SELECT period_type, count(*) AS n FROM b_eligible GROUP BY 1")
def diagnostics(spark, sf):
    return sg.diagnostics(eligible_signals(spark, sf), "period_type")


@book.add("m16_expected_value_targets", "symbol date:d direction weight:f6 strike:f2 kelly_fraction:f edge:f")
def expected_value_targets(spark, sf):
    e = cut(eligible_signals(spark, sf, oriented=True))
    market = e.select("date", "symbol", (F.lit(0.2) + (F.col("user_id") % 30) / 100).alias("sigma"), F.lit(0.04).alias("r"), F.lit(0.018).alias("q"),
                      F.when(F.col("user_id") % 2 == 0, F.array(*[F.lit(float(k)) for k in range(60, 161, 10)])).alias("strikes"))
    return sg.STRATEGIES["option_expected_value"](e, dims.inflation(spark), market)
