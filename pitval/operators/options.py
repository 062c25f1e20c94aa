"""Option chains: quotes, contract selection, pricing, implied volatility, payoff moments, fees."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import dims
from ..functions.normal import cdf, cdf_array, pdf
from ..session import cut, stack
from .asof import around, asof_join
from .ordering import exact_quantiles, ranked, running_before

# -- quotes -------------------------------------------------------------------------------


def premium(bid: Column, ask: Column, last: Column, close: Column | None = None) -> Column:
    """Middle of the quote if both sides are there, else last trade, else close."""
    mid = F.when(bid.isNotNull() & ask.isNotNull(), (bid + ask) / 2)
    return F.coalesce(mid, last, *([close] if close is not None else []))


def multiplier(c: Column, default: float = 100.0) -> Column:
    return F.coalesce(F.nullif(c.cast("double"), F.lit(0.0)), F.lit(default))


def without_sentinel(c: Column) -> Column:
    """Feeds write -1 or NaN for 'no quote'."""
    return F.when(~F.isnan(c) & (c != -1), c)


def add_liquidity(df: DataFrame) -> DataFrame:
    mid = (F.col("bid") + F.col("ask")) / 2
    return df.withColumns({"spread_abs": F.col("ask") - F.col("bid"),
                           "spread_pct": (F.col("ask") - F.col("bid")) / F.nullif(mid, F.lit(0.0)),
                           "oi_volume_ratio": F.col("open_interest") / F.nullif(F.col("volume").cast("double"), F.lit(0.0))})


def half_spreads(df: DataFrame) -> DataFrame:
    """Rows quoted coherently on both sides, with half the spread in percent of the middle."""
    ok = (F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") >= F.col("bid"))
    mid = (F.col("bid") + F.col("ask")) / 2
    return df.where(ok).withColumns({"mid": mid, "half_spread_pct": (F.col("ask") - F.col("bid")) / (2 * mid) * 100})


def add_terms(df: DataFrame, as_of: str = "snapshot_date") -> DataFrame:
    """Days to expiry, moneyness in percent and in logs."""
    return df.withColumns({"tenor_days": F.datediff("expiry", as_of),
                           "moneyness_pct": (F.col("strike") / F.nullif(F.col("spot"), F.lit(0.0)) - 1) * 100,
                           "log_moneyness": F.ln(F.col("strike") / F.nullif(F.col("spot"), F.lit(0.0)))})


def candidates(df: DataFrame, min_days: int, band: float) -> DataFrame:
    """Contracts expiring later than ``min_days`` with a strike within the band around spot."""
    k, s = F.col("strike"), F.col("spot")
    return df.where((F.col("tenor_days") > min_days) & (k >= s * (1 - band)) & (k <= s * (1 + band)))


def banded(df: DataFrame, value: str, by: str, bands: Sequence[tuple[float, float]]) -> DataFrame:
    """n, mean, median and upper quantiles of a value per band (low inclusive)."""
    band = F.lit(None).cast("double")
    for lo, hi in reversed(list(bands)):
        band = F.when((F.col(by) >= lo) & (F.col(by) < hi), F.lit(lo)).otherwise(band)
    inside = df.withColumn("band_from", band).where("band_from is not null").select("band_from", value)
    mean = inside.groupBy("band_from").agg(F.avg(value).alias("mean"))
    q = exact_quantiles(inside, ["band_from"], value, {"median": 0.5, "p75": 0.75, "p90": 0.9}, count="n")
    return q.join(mean, "band_from")


# -- contract selection -------------------------------------------------------------------


def match_contracts(chain: DataFrame, other: DataFrame, keys: Sequence[str], fill: Sequence[str],
                    tolerance: float = 1e-6) -> DataFrame:
    """Fill missing quotes from a second source whose strikes agree up to a tolerance.

    Strikes meet in a bucket far wider than the tolerance or in the next one, so
    the join stays an equi join. ``iv_source`` says which source gave the volatility.
    """
    bucket = F.round(F.col("strike") * 1e4).cast("long")
    left = chain.withColumn("_b", bucket)
    right = other.select(*keys, F.col("strike").alias("_k"), *[F.col(c).alias(f"_{c}") for c in fill],
                         F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    near = right.join(left.select(*keys, "strike", "_b").distinct(), [*keys, "_b"]) \
        .where(F.abs(F.col("_k") - F.col("strike")) <= tolerance)
    best = near.groupBy(*keys, "strike").agg(F.min_by(
        F.struct(*[f"_{c}" for c in fill]), F.struct(F.abs(F.col("_k") - F.col("strike")), F.col("_k"))).alias("_r"))
    out = chain.join(best, [*keys, "strike"], "left")
    if "iv" in fill:
        out = out.withColumn("iv_source", F.when(F.col("iv").isNotNull(), "primary")
                             .when(F.col("_r._iv").isNotNull(), "secondary"))
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_r._{c}")) for c in fill}).drop("_r")


LEG = ("symbol", "option_type", "snapshot_date")


def usable_snapshot(requests: DataFrame, chain: DataFrame, tolerance_days: int = dims.SNAPSHOT_TOLERANCE_DAYS) -> DataFrame:
    """Last snapshot day at or before each request, if near enough."""
    days = chain.select("symbol", "option_type", "snapshot_date").distinct()
    return asof_join(requests, days.withColumnRenamed("snapshot_date", "_s"), ["symbol", "option_type"], "as_of", "_s", [],
                     tolerance_days, matched="snapshot_date")


def nearest_contract(requests: DataFrame, chain: DataFrame, values: Sequence[str],
                     target_tenor: int = dims.TARGET_TENOR_DAYS,
                     tolerance_days: int = dims.SNAPSHOT_TOLERANCE_DAYS) -> DataFrame:
    """Contract of the usable snapshot closest to the wanted strike, then to the tenor.

    ``requests``: symbol, option_type, as_of, target_strike (NULL: at the money).
    The chain is read once: per listed strike its best tenor and its candidate at the
    money. The nearest strike is the closer of the next lower and the next higher one,
    which a segmented scan finds, so a leg may list any number of strikes and no request
    meets the chain pairwise.
    """
    leg = list(LEG)
    off = F.abs(F.col("tenor_days") - target_tenor)
    contract = F.struct("tenor_days", *values)
    ladder = cut(chain.groupBy(*leg, "strike").agg(
        F.min_by(contract, F.struct(off, F.col("tenor_days"))).alias("c"),
        F.min(F.struct(F.abs(F.col("moneyness_pct")).alias("far"), off.alias("off"), F.col("strike"), F.col("tenor_days"), contract.alias("c"))).alias("money")))
    asked = usable_snapshot(requests, ladder, tolerance_days)
    rung = ladder.select(*leg, "strike", F.struct("strike", "c").alias("_c"))
    found = around(asked, leg, "target_strike", rung, "strike", "_c", "_low", "_high")
    # of equal candidates the first by tenor, as of all contracts of the leg
    atm = ladder.groupBy(*leg).agg(F.min_by(F.struct("strike", F.col("money.c").alias("c")), F.struct("money.far", "money.off", "strike", "money.tenor_days")).alias("_atm"))
    found = found.join(atm, leg, "left")

    def distance(c: str) -> Column:
        return F.struct(F.abs(F.col(f"{c}.strike") - F.col("target_strike")),
                        F.abs(F.col(f"{c}.c.tenor_days") - target_tenor), F.col(f"{c}.strike"))

    pick = (F.when(F.col("target_strike").isNull(), F.col("_atm")).when(F.col("_low").isNull(), F.col("_high"))
            .when(F.col("_high").isNull(), F.col("_low"))
            .when(distance("_high") < distance("_low"), F.col("_high")).otherwise(F.col("_low")))
    return found.withColumn("_p", pick).select(*requests.columns, "snapshot_date", F.col("_p.strike").alias("strike"),
                                               "_p.c.*")


def _rungs(chain: DataFrame, target_tenor: int) -> tuple[DataFrame, DataFrame]:
    """One row per listed strike of the chain, read once; and of these the strikes listed for the leg's nearest tenor."""
    off = F.abs(F.col("tenor_days") - target_tenor)
    ladder = cut(chain.groupBy(*LEG, "strike").agg(F.min(off).alias("off")))
    nearest = ladder.groupBy(*LEG).agg(F.min("off").alias("_off"))
    return ladder, ladder.where("strike > 0").join(nearest, list(LEG)).where("off = _off").select(*LEG, "strike")


def listed_strikes(requests: DataFrame, chain: DataFrame, target_tenor: int = dims.TARGET_TENOR_DAYS,
                   tolerance_days: int = dims.SNAPSHOT_TOLERANCE_DAYS) -> DataFrame:
    """``requests`` with ``snapshot_date``, ``rung`` and ``strike``: a row per listed strike of the tenor nearest the target, rungs from 1 up.

    The form for legs of any number of strikes: rungs come from ``ranked``, nothing is
    collected. A request without a usable snapshot or a listed strike has no row.
    """
    ladder, rungs = _rungs(chain, target_tenor)
    placed = ranked(rungs, LEG, [F.col("strike")], "rung")
    return usable_snapshot(requests, ladder, tolerance_days).join(placed, list(LEG)).select(*requests.columns, "snapshot_date", "rung", "strike")


def quoted_strikes(requests: DataFrame, chain: DataFrame, target_tenor: int = dims.TARGET_TENOR_DAYS,
                   tolerance_days: int = dims.SNAPSHOT_TOLERANCE_DAYS) -> DataFrame:
    """Sorted listed strikes of the tenor nearest the target at the usable snapshot, as one array: for ladders as exchanges list them."""
    ladder, rungs = _rungs(chain, target_tenor)
    strikes = rungs.groupBy(*LEG).agg(F.sort_array(F.collect_list("strike")).alias("strikes"))
    return usable_snapshot(requests, ladder, tolerance_days).join(strikes, list(LEG), "left")


def strike_target(moneyness: Column, value: Column, spot: Column) -> Column:
    """Moneyness times spot, else halfway between value and spot, else (or if not positive) at the money."""
    wish = F.when(moneyness > 0, moneyness * spot).otherwise((value + spot) / 2)
    return F.when(wish > 0, wish)


# -- pricing ------------------------------------------------------------------------------


def price_and_greeks(df: DataFrame, spot: str = "spot", strike: str = "strike", years: str = "t", vol: str = "iv",
                     rate: str = "r", dividend: str = "q") -> DataFrame:
    """Black-Scholes-Merton price, delta, gamma, vega per point and theta per day; intrinsic if degenerate."""
    s, k, t, v, r, q = (F.col(c) for c in (spot, strike, years, vol, rate, dividend))
    live = (t > 0) & (v > 0)
    call = F.col("option_type") == "CALL"
    df = df.withColumn("_sd", F.when(live, v * F.sqrt(t)))
    df = df.withColumn("_d1", (F.ln(s / k) + (r - q + v * v / 2) * t) / F.col("_sd"))
    df = df.withColumn("_d2", F.col("_d1") - F.col("_sd"))
    sign = F.when(call, 1.0).otherwise(-1.0)
    df = df.withColumns({"_n1": cdf(sign * F.col("_d1")), "_n2": cdf(sign * F.col("_d2")), "_p1": pdf(F.col("_d1")),
                         "_ds": s * F.exp(-q * t), "_dk": k * F.exp(-r * t)})
    n1, n2, p1, ds, dk = (F.col(c) for c in ("_n1", "_n2", "_p1", "_ds", "_dk"))
    intrinsic = F.greatest(F.lit(0.0), sign * (s - k))
    decay = -ds * p1 * v / (2 * F.sqrt(t))
    out = df.withColumns({
        "price": F.when(live, sign * (ds * n1 - dk * n2)).otherwise(intrinsic),
        "delta": F.when(live, sign * F.exp(-q * t) * n1).otherwise(F.when(sign * (s - k) > 0, sign).otherwise(0.0)),
        "gamma": F.when(live, F.exp(-q * t) * p1 / (s * F.col("_sd"))).otherwise(0.0),
        "vega": F.when(live, ds * p1 * F.sqrt(t) / 100).otherwise(0.0),
        "theta": F.when(live, (decay + sign * (q * ds * n1 - r * dk * n2)) / 365).otherwise(0.0),
    })
    return out.drop("_sd", "_d1", "_d2", "_n1", "_n2", "_p1", "_ds", "_dk")


def add_carry(df: DataFrame, rates: DataFrame, yields: DataFrame, date: str, sector: str = "sector") -> DataFrame:
    """Rate known at the date (last year's mean) and the sector's dividend yield, with defaults."""
    r = F.broadcast(rates.select((F.col("year") + 1).alias("_in"), F.col("rate").alias("_r")))
    q = F.broadcast(yields.select(F.col("sector").alias(sector), F.col("dividend_yield").alias("_q")))
    out = df.join(r, F.year(date) == F.col("_in"), "left").join(q, sector, "left")
    return out.withColumns({"r": F.coalesce("_r", F.lit(dims.RISK_FREE_DEFAULT)),
                            "q": F.coalesce("_q", F.lit(dims.DIVIDEND_YIELD_DEFAULT))}).drop("_in", "_r", "_q")


def _price_array(s, k, t, v, r, call):
    sd = v * np.sqrt(t)
    d1 = (np.log(s / k) + (r + v * v / 2) * t) / sd
    sign = np.where(call, 1.0, -1.0)
    return sign * (s * cdf_array(sign * d1) - k * np.exp(-r * t) * cdf_array(sign * (d1 - sd)))


def implied_vol(df: DataFrame, price: str = "mid", rate: float = dims.RISK_FREE_DEFAULT, out: str = "implied_vol") -> DataFrame:
    """Invert the price on [1e-4, 5] by bisection over whole Arrow batches.

    NULL under the intrinsic value or where no root exists. Needs spot, strike, t, option_type.
    """
    @F.pandas_udf("double")
    def solve(p: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, kind: pd.Series) -> pd.Series:
        p, s, k, t = (x.to_numpy(float) for x in (p, s, k, t))
        call = (kind == "CALL").to_numpy()
        with np.errstate(all="ignore"):
            lo, hi = np.full(len(p), 1e-4), np.full(len(p), 5.0)
            fits = ((p > 0) & (s > 0) & (k > 0) & (t > 0) & (p >= np.maximum(0, np.where(call, s - k, k - s)))
                    & (_price_array(s, k, t, lo, rate, call) <= p) & (_price_array(s, k, t, hi, rate, call) >= p))
            for _ in range(60):
                mid = (lo + hi) / 2
                below = _price_array(s, k, t, mid, rate, call) < p
                lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return pd.Series(np.where(fits, (lo + hi) / 2, np.nan))

    solved = solve(price, "spot", "strike", "t", "option_type")
    return df.withColumn(out, F.nanvl(solved, F.lit(None).cast("double")))


def enrich_iv(df: DataFrame, price: str = "mid") -> DataFrame:
    """Keep a quoted volatility, estimate a missing one, and say which it is."""
    df = implied_vol(df, price, out="_est")
    return df.withColumn("iv_source", F.when(F.col("iv").isNotNull(), "quoted").when(F.col("_est").isNotNull(), "estimated")) \
        .withColumn("iv", F.coalesce("iv", "_est")).drop("_est")


def payoff_moments(df: DataFrame, spot: str = "spot", strike: str = "strike", drift: str = "mu", vol: str = "sigma",
                   years: str = "t", paid: str = "premium") -> DataFrame:
    """Expected payoff, deviation, downside semideviation, chance of profit and Sharpe ratio under a drift."""
    s, k, mu, v, t, p = (F.col(c) for c in (spot, strike, drift, vol, years, paid))
    call = F.col("option_type") == "CALL"
    df = df.withColumns({"_sd": v * F.sqrt(t), "_m1": s * F.exp(mu * t), "_m2": s * s * F.exp((2 * mu + v * v) * t),
                         "_b": F.when(call, k + p).otherwise(k - p)})
    for level, tag in ((k, "k"), (F.col("_b"), "b")):
        z = (F.ln(s / F.when(level > 0, level)) + (mu + v * v / 2) * t) / F.col("_sd")
        df = df.withColumn(f"_z{tag}", z)
        zt = F.col(f"_z{tag}")
        # probability, first and second moment of the price below the level
        df = df.withColumns({f"_p{tag}": F.coalesce(cdf(F.col("_sd") - zt), F.lit(0.0)),
                             f"_e{tag}": F.coalesce(F.col("_m1") * cdf(-zt), F.lit(0.0)),
                             f"_s{tag}": F.coalesce(F.col("_m2") * cdf(-(zt + F.col("_sd"))), F.lit(0.0))})
    pk, ek, sk, pb, eb, sb, b = (F.col(c) for c in ("_pk", "_ek", "_sk", "_pb", "_eb", "_sb", "_b"))
    mean = F.when(call, F.col("_m1") - ek - k * (1 - pk)).otherwise(k * pk - ek)
    second = F.when(call, (F.col("_m2") - sk) - 2 * k * (F.col("_m1") - ek) + k * k * (1 - pk)) \
        .otherwise(k * k * pk - 2 * k * ek + sk)
    between = F.when(call, b * b * (pb - pk) - 2 * b * (eb - ek) + (sb - sk)) \
        .otherwise((sk - sb) - 2 * b * (ek - eb) + b * b * (pk - pb))
    lost = F.when(call, pk).otherwise(1 - pk)
    df = df.withColumns({"expected_payoff": mean, "_second": second})
    df = df.withColumn("std_payoff", F.sqrt(F.greatest(F.lit(0.0), F.col("_second") - F.col("expected_payoff") * F.col("expected_payoff"))))
    df = df.withColumns({
        "edge": F.col("expected_payoff") - p,
        "downside_semideviation": F.sqrt(F.greatest(F.lit(0.0), p * p * lost + between)),
        "probability_of_profit": F.when(call, 1 - pb).otherwise(pb),
        "sharpe": (F.col("expected_payoff") - p) / F.nullif(F.col("std_payoff"), F.lit(0.0))})
    return df.drop("_sd", "_m1", "_m2", "_b", "_second", *[f"_{a}{t}" for a in "zpes" for t in "kb"])


def convergence_drift(value: Column, spot: Column, years: Column, fraction: float) -> Column:
    return F.when((spot > 0) & (value > 0) & (years > 0), fraction * F.ln(value / spot) / years)


def volatility_choice(implied: Column, realized: Column, lo: float = 0.05, hi: float = 2.0) -> tuple[Column, Column]:
    """Implied, else realised, each kept in bounds, else a constant; and which one it was."""
    bound = lambda c: F.when(c > 0, F.greatest(F.lit(lo), F.least(F.lit(hi), c)))
    value = F.coalesce(bound(implied), bound(realized), F.lit(dims.FALLBACK_VOL))
    label = F.when(implied > 0, "implied").when(realized > 0, "realized").otherwise("constant")
    return value, label


# -- strike selection ---------------------------------------------------------------------

NODES = 128
WIDEST = 10.0
MOST_STAKE = 0.999


def strike_grid(df: DataFrame, n_sigma: float = 3.0, step: float = 0.25) -> DataFrame:
    """Explode each row into log-spaced strikes around spot (a fixed number per row)."""
    n = int(round(n_sigma / step))
    width = F.col("sigma") * F.sqrt("t")
    grid = F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda i: F.col("spot") * F.exp(i * step * width))
    return df.where("spot > 0 and sigma > 0 and t > 0").withColumn("strike", F.explode(grid))


CHUNK = 256
PASSES = 100


def log_optimal(weight, gain, lost):
    """Stakes at which the growth of each row stops rising, and the passes over the nodes it took.

    The slope falls with the stake and changes sign between 0 and ``MOST_STAKE``. Newton steps
    find the place in a few passes; one that leaves the bracket halves it instead. A row stays
    as it is once it has settled, whatever rows are beside it.
    """
    out, at = np.empty(len(gain)), np.arange(len(gain))
    a, b = np.zeros(len(gain)), np.full(len(gain), MOST_STAKE)
    f = (a + b) / 2
    for n in range(PASSES):
        if not len(at):
            return out, n
        ratio = gain / (1 + f[:, None] * gain)
        mean = weight * ratio
        slope = mean.sum(axis=1) - lost / (1 - f)
        bend = (mean * ratio).sum(axis=1) + lost / (1 - f) ** 2
        up = slope > 0
        a, b = np.where(up, f, a), np.where(up, b, f)
        step = f + slope / bend
        step = np.where((step >= a) & (step <= b), step, (a + b) / 2)
        out[at] = step
        open_ = np.abs(step - f) > 1e-12
        f = step
        if not open_.all():
            at, f, a, b, weight, gain, lost = (z[open_] for z in (at, f, a, b, weight, gain, lost))
    return out, PASSES


def _growth_of(s, k, mu, v, t, p, call, x, w):
    """Stake and growth of one chunk of candidates (columns) over the quadrature nodes (rows of x, w)."""
    sd = v * np.sqrt(t)
    zk = (np.log(k / s) - (mu - v * v / 2) * t) / sd
    lo, hi = np.where(call, zk, -WIDEST), np.where(call, WIDEST, zk)
    half = (hi - lo) / 2
    z = half * x + (hi + lo) / 2
    weight = w * half * np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
    end = s * np.exp((mu - v * v / 2) * t + sd * z)
    gain = np.where(call, end - k, k - end) / p - 1
    lost = np.where(call, cdf_array(zk), 1 - cdf_array(zk))
    weighted = weight * gain

    def slope(f):
        return (weighted / (1 + f * gain)).sum(axis=1, keepdims=True) - lost / (1 - f)

    usable = (p > 0) & (hi > lo) & (slope(np.zeros_like(s)) > 0)
    f = np.full_like(s, MOST_STAKE)
    inside = (usable & ~(slope(f) > 0))[:, 0]
    f[inside, 0] = log_optimal(weight[inside], gain[inside], lost[inside, 0])[0]
    growth = (weight * np.log1p(f * gain)).sum(axis=1, keepdims=True) + np.where(lost > 0, lost * np.log1p(-f), 0)
    ok = usable & np.isfinite(growth)
    return np.where(ok, f, np.nan)[:, 0], np.where(ok, growth, np.nan)[:, 0]


def _growth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Log-optimal stake and growth per candidate; small chunks keep the node arrays in cache."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    for rows in batches:
        cols = [rows[c].to_numpy(float)[:, None] for c in ("spot", "strike", "mu", "sigma", "t", "premium")]
        call = (rows["option_type"] == "CALL").to_numpy()[:, None]
        out = []
        with np.errstate(all="ignore"):
            for i in range(0, len(rows), CHUNK):
                out.append(_growth_of(*[c[i:i + CHUNK] for c in cols], call[i:i + CHUNK], x, w))
        stake, growth = (np.concatenate(z) for z in zip(*out)) if out else (np.empty(0), np.empty(0))
        yield rows.assign(kelly_fraction=stake, log_growth=growth)


def add_growth(df: DataFrame) -> DataFrame:
    # a candidate costs far more time than bytes, so spread by rows rather than by size
    spark = df.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df = df.repartition(width)
    out = df.mapInPandas(_growth, df.withColumns({"kelly_fraction": F.lit(0.0), "log_growth": F.lit(0.0)}).schema)
    none = F.lit(None).cast("double")
    return out.withColumns({c: F.nanvl(F.col(c), none) for c in ("kelly_fraction", "log_growth")})


def best_strike(df: DataFrame, keys: Sequence[str], criterion: str = "kelly", premium: str = "premium") -> DataFrame:
    """Best candidate with a positive edge per key; how many were tried and had none.

    ``df``: candidates (spot, strike, mu, sigma, t, option_type, and the column ``premium`` names:
    a model price, a quoted ask, a middle). The choice is a combinable max_by, so a key with
    many candidates is reduced map-side. The result calls the premium paid ``premium``.
    """
    if premium != "premium":
        df = df.withColumn("premium", F.col(premium).cast("double"))
    if criterion not in ("kelly", "sharpe"):
        raise ValueError(f"criterion must be kelly or sharpe, not {criterion!r}")
    # only what tells a candidate moves on: other columns would be written, dealt and turned into Python objects per strike
    df = df.select(*dict.fromkeys([*keys, "spot", "strike", "mu", "sigma", "t", "option_type", "premium"]))
    df = cut(payoff_moments(df.where("strike > 0")))  # counted and scored from one evaluation
    tried = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_candidates"),
                                  F.count_if((F.col("premium") > 0) & (F.col("edge") <= 0)).alias("n_negative_edge"))
    positive = df.where("premium > 0 and edge > 0")
    scored = add_growth(positive).withColumn("score", F.col("log_growth")) if criterion == "kelly" else \
        positive.withColumns({"kelly_fraction": F.lit(None).cast("double"), "log_growth": F.lit(None).cast("double"),
                              "score": F.col("sharpe")})
    kept = ["strike", "premium", "score", "kelly_fraction", "expected_payoff", "edge", "std_payoff",
            "downside_semideviation", "probability_of_profit"]
    best = scored.where("score is not null").groupBy(*keys).agg(
        F.max_by(F.struct(*kept), F.struct(F.col("score"), -F.col("strike"))).alias("b")).select(*keys, "b.*")
    return tried.join(best, list(keys), "left")


def expected_value_strikes(targets: DataFrame, keys: Sequence[str], quoted: str | None = None, fraction: float = 0.8,
                           criterion: str = "kelly") -> DataFrame:
    """Targets with the strike that grows capital fastest; those without a positive edge drop out.

    ``targets``: spot, theoretical, sigma, t, r, q, option_type. ``quoted`` names an
    array of listed strikes: those inside the theoretical window replace the grid.
    The weights of the others are left as they are.
    """
    base = targets.withColumn("mu", convergence_drift(F.col("theoretical"), F.col("spot"), F.col("t"), fraction)).where("mu is not null")
    grid = strike_grid(base)
    if quoted:
        reach = 3.0 * F.col("sigma") * F.sqrt("t")
        listed = F.filter(quoted, lambda k: (k >= F.col("spot") * F.exp(-reach)) & (k <= F.col("spot") * F.exp(reach)))
        has = base.withColumn("_listed", listed).where("size(_listed) > 0")
        grid = stack(has.withColumn("strike", F.explode("_listed")).drop("_listed"),
                     strike_grid(base.where((F.coalesce(F.size(listed), F.lit(0)) <= 0))))
    priced = price_and_greeks(grid, vol="sigma").withColumn("premium", F.col("price"))
    best = best_strike(priced, keys, criterion).where("strike is not null")
    return targets.join(best, list(keys)).withColumn("strike_moneyness", F.col("strike") / F.col("spot"))


# -- orders and fees ----------------------------------------------------------------------


def interleaved(orders: DataFrame, keys: Sequence[str], size: str, tie: Sequence[str]) -> DataFrame:
    """Execution order: sells first, then calls and puts in turn by size, then the undirected."""
    orders = orders.withColumn("_lane", F.when(F.col(size) <= 0, "sell").when(F.col("option_type").isin("CALL", "PUT"), F.col("option_type"))
                               .otherwise("other"))
    order = [F.when(F.col("_lane").isin("CALL", "PUT"), -F.col(size)).otherwise(0.0), *[F.col(c) for c in tie]]
    lane = ranked(orders, [*keys, "_lane"], order, "rank")
    phase = F.when(F.col("_lane") == "sell", 0).when(F.col("_lane") == "other", 2).otherwise(1)
    return ranked(lane.withColumn("_phase", phase), keys,
                  [F.col("_phase"), F.col("rank"), F.col("_lane"), *[F.col(c) for c in tie]], "position") \
        .withColumnRenamed("_lane", "lane").drop("_phase")


def order_fees(executions: DataFrame, keys: Sequence[str], order: Sequence[str],
               tiers=dims.COMMISSION_TIERS, minimum: float = dims.COMMISSION_MINIMUM) -> DataFrame:
    """Tiered commission by the month's volume so far and by premium, plus per-contract and sell-side fees."""
    ex = executions.withColumns({"_month": F.trunc("date", "month"), "_size": F.abs("contracts")})
    ex = running_before(ex, [*keys, "_month"], [F.col(c) for c in order], "_size", "monthly_contracts")
    paid = F.greatest(F.col("price"), F.lit(0.0))
    rate = F.lit(None).cast("double")
    for upto, bands in reversed(tiers):
        inner = F.lit(None).cast("double")
        for below, value in reversed(bands):
            inner = F.lit(value) if below is None else F.when(paid < below, F.lit(value)).otherwise(inner)
        rate = inner if upto is None else F.when(F.col("monthly_contracts") <= upto, inner).otherwise(rate)
    size = F.col("_size")
    fees = size * (dims.FEE_ORF + dims.FEE_CAT + dims.FEE_OCC)
    selling = size * dims.FEE_TAF + size * F.col("multiplier") * paid * dims.FEE_SEC
    ex = ex.withColumn("commission_rate", rate)
    total = F.greatest(size * F.col("commission_rate"), F.lit(minimum)) + fees + F.when(F.col("side") == "sell", selling).otherwise(0.0)
    return ex.withColumn("fees", F.when(size > 0, total).otherwise(0.0)).drop("_month", "_size")


# -- surface views ------------------------------------------------------------------------


def atm_term_structure(chain: DataFrame) -> DataFrame:
    """Volatility of the contract nearest the money per (symbol, snapshot, expiry)."""
    return chain.where("iv is not null").groupBy("symbol", "snapshot_date", "expiry").agg(
        F.min_by(F.struct("tenor_days", "strike", "iv"), F.struct(F.abs("moneyness_pct"), F.col("strike"), F.col("option_type")))
        .alias("r")).select("symbol", "snapshot_date", "expiry", "r.*")


def put_call_skew(chain: DataFrame) -> DataFrame:
    """Mean volatility of 15-30 % out-of-the-money puts less calls, and the volume ratio, per snapshot and expiry."""
    m, kind = F.col("moneyness_pct"), F.col("option_type")
    out = chain.groupBy("symbol", "snapshot_date", "expiry").agg(
        F.avg(F.when((kind == "CALL") & m.between(15, 30), F.col("iv"))).alias("_c"),
        F.avg(F.when((kind == "PUT") & m.between(-30, -15), F.col("iv"))).alias("_p"),
        F.sum(F.when(kind == "CALL", F.col("volume"))).alias("_vc"), F.sum(F.when(kind == "PUT", F.col("volume"))).alias("_vp"))
    return out.select("symbol", "snapshot_date", "expiry", (F.col("_p") - F.col("_c")).alias("skew_put_call"),
                      (F.coalesce("_vp", F.lit(0)) / F.nullif(F.col("_vc"), F.lit(0))).alias("volume_ratio"))


def portfolio_greeks(positions: DataFrame, by: Sequence[str], quantity: Column) -> DataFrame:
    """Absolute delta notional, theta and vega of a book, from priced positions."""
    return positions.groupBy(*by).agg(
        F.sum(F.abs("delta") * F.col("spot") * quantity).alias("delta_notional"),
        F.sum(F.col("theta") * quantity).alias("theta_per_day"), F.sum(F.col("vega") * quantity).alias("vega_notional"))


def smooth_surface(chain: DataFrame, keys: Sequence[str], points: int = 8, min_points: int = 5, width: float = 0.35) -> DataFrame:
    """Kernel-smoothed volatility on a regular (log-moneyness, days) grid per chain.

    Each quote adds to the fixed number of grid points, so the work is linear in
    the quotes and the sums combine map-side; chains under ``min_points`` quotes
    have no surface.
    """
    usable = chain.where("iv > 0 and tenor_days > 0 and log_moneyness is not null")
    span = usable.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("log_moneyness").alias("_x0"), F.max("log_moneyness").alias("_x1"),
        F.min("tenor_days").alias("_y0"), F.max("tenor_days").alias("_y1"),
        F.stddev_pop("log_moneyness").alias("_sx"), F.stddev_pop("tenor_days").alias("_sy")).where(F.col("_n") >= min_points)
    q = usable.join(span, list(keys)).withColumns({
        "grid_x": F.explode(F.sequence(F.lit(0), F.lit(points - 1))), })
    q = q.withColumn("grid_y", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at_x = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * F.col("grid_x") / (points - 1)
    at_y = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * F.col("grid_y") / (points - 1)
    dx = (F.col("log_moneyness") - at_x) / (F.col("_sx") + 1e-9)
    dy = (F.col("tenor_days") - at_y) / (F.col("_sy") + 1e-9)
    q = q.withColumns({"at_log_moneyness": at_x, "at_days": at_y, "_w": F.exp(-(dx * dx + dy * dy) / (2 * width * width))})
    out = q.groupBy(*keys, "grid_x", "grid_y").agg(
        F.first("at_log_moneyness").alias("log_moneyness"), F.first("at_days").alias("days"), F.sum("_w").alias("_sw"),
        F.sum(F.col("_w") * F.col("iv")).alias("_sv"), F.sum(F.col("_w") * F.col("iv") * F.col("iv")).alias("_svv"))
    iv = F.col("_sv") / F.nullif(F.col("_sw"), F.lit(0.0))
    return out.withColumns({"iv": iv, "iv_std": F.sqrt(F.greatest(F.lit(0.0), F.col("_svv") / F.nullif(F.col("_sw"), F.lit(0.0)) - iv * iv))}) \
        .drop("_sw", "_sv", "_svv")


def flag_anomalies(chain: DataFrame, keys: Sequence[str], features: Sequence[str], contamination: float = 0.05,
                   min_rows: int = 10) -> DataFrame:
    """Most atypical share of each chain by summed squared z-scores; tiny chains flag nothing."""
    usable = chain.where(" and ".join(f"{f} is not null" for f in features))
    stats = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[x for f in features for x in (
        F.avg(f).alias(f"_m_{f}"), F.stddev_pop(f).alias(f"_s_{f}"))])
    z = [((F.col(f) - F.col(f"_m_{f}")) / F.nullif(F.col(f"_s_{f}"), F.lit(0.0))) for f in features]
    score = sum((F.coalesce(c * c, F.lit(0.0)) for c in z[1:]), F.coalesce(z[0] * z[0], F.lit(0.0)))
    scored = usable.join(stats, list(keys)).withColumn("anomaly_score", F.sqrt(score))
    cutoff = exact_quantiles(scored.select(*keys, "anomaly_score"), list(keys), "anomaly_score", {"_cut": 1 - contamination})
    out = scored.join(cutoff, list(keys))
    return out.withColumn("is_anomaly", (F.col("_n") >= min_rows) & (F.col("anomaly_score") > F.col("_cut"))) \
        .drop("_n", "_cut", *[f"_{a}_{f}" for f in features for a in "ms"])
