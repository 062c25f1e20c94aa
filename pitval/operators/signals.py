"""Scores, thresholds, eligibility, capped weights and the strategy registry."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from math import floor

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import dims
from ..session import cut
from .asof import asof_join, event_between
from .ordering import exact_quantiles, null_safe_join, top_k
from .spans import with_membership


def threshold_flags(df: DataFrame, gap: str, entry: float = dims.ENTRY_THRESHOLD_PCT,
                    exit_ratio: float = dims.EXIT_THRESHOLD_RATIO) -> DataFrame:
    """Entry and (lower) exit test from one scored projection."""
    size = F.abs(F.col(gap))
    return df.withColumns({"enter": size >= entry, "keep": size >= entry * exit_ratio})


def directions(df: DataFrame, gap: str, cap: float | None = None) -> DataFrame:
    size = F.abs(F.col(gap))
    return df.withColumns({"direction": F.when(F.col(gap) > 0, "CALL").otherwise("PUT"),
                           "conviction": size if cap is None else F.least(size, F.lit(cap))})


def _known_inflation(df: DataFrame, inflation: DataFrame, published: str) -> DataFrame:
    known = F.broadcast(inflation.select((F.col("year") + 1).alias("_in"), (F.col("pct") / 100).alias("_pi")))
    return df.join(known, F.year(published) == F.col("_in"), "left").withColumn(
        "_pi", F.coalesce("_pi", F.lit(dims.INFLATION_DEFAULT / 100))).drop("_in")


def inflation_adjusted(df: DataFrame, inflation: DataFrame, gap: str, published: str, years: float,
                       log: bool = False, out: str = "adjusted_gap") -> DataFrame:
    """Gap towards a nominal value that grows with the inflation known at publication."""
    df = _known_inflation(df, inflation, published)
    if log:
        adjusted = F.col(gap) + F.log1p(F.col("_pi")) * years * 100
    else:
        adjusted = ((1 + F.col(gap) / 100) * F.pow(1 + F.col("_pi"), F.lit(float(years))) - 1) * 100
    return df.withColumn(out, adjusted).drop("_pi")


def capped_weights(df: DataFrame, keys: Sequence[str], conviction: str, order: str,
                   cap_pct: float = dims.POSITION_CAP_PCT, out: str = "weight") -> DataFrame:
    """Weights proportional to conviction, none above the cap, the excess passed on.

    At most 1/cap rows can sit at the cap, so only that many top rows per group
    have to be ordered; the group total comes from a combinable aggregate. The
    share of the k-th row once the k-1 above it are capped says whether it is
    capped too; the first that is not fixes the scale of all the rest. With too
    few rows for the cap to bind, each takes the cap and the rest stays cash.
    """
    keys, cap = list(keys), cap_pct / 100
    c = F.col(conviction)
    totals = df.groupBy(*keys).agg(F.sum(c).alias("_total"), F.count(F.lit(1)).alias("_rows"))
    most = floor(1 / cap + 1e-9) + 1
    head = top_k(df.select(*keys, c.alias("_c"), order), keys, [F.col("_c").desc(), F.col(order).asc()], most)
    head = null_safe_join(head, totals, keys, "inner")
    w = Window.partitionBy(*keys).orderBy(F.col("_c").desc(), F.col(order).asc())
    above = F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    head = head.withColumns({"_k": F.row_number().over(w) - 1, "_left": F.col("_total") - above})
    scale = (1 - F.col("_k") * cap) / F.nullif(F.col("_left"), F.lit(0.0))
    free = head.withColumn("_scale", scale).where(F.col("_scale") * F.col("_c") <= cap)
    level = free.groupBy(*keys).agg(F.min_by("_scale", "_k").alias("_scale"))
    out_df = null_safe_join(null_safe_join(df, totals, keys), level, keys)
    weight = (F.when(F.col("_total") <= 0, c)
              .when(F.col("_rows") * cap <= 1 + 1e-12, F.lit(cap))
              .otherwise(F.least(F.lit(cap), c * F.coalesce("_scale", F.lit(float("inf"))))))
    return out_df.withColumn(out, weight).drop("_total", "_rows", "_scale")


def cap_by_group(df: DataFrame, keys: Sequence[str], group: str, weight: str = "weight",
                 cap_pct: float = dims.SECTOR_CAP_PCT) -> DataFrame:
    """Scale each (date, sector) down to the cap, without passing anything on."""
    g = [*keys, "_group"]
    df = df.withColumn("_group", F.coalesce(F.col(group), F.lit("_unknown")))
    totals = df.groupBy(*g).agg(F.sum(weight).alias("_sum"))
    factor = F.least(F.lit(1.0), F.lit(cap_pct / 100) / F.nullif(F.col("_sum"), F.lit(0.0)))
    return df.join(totals, g).withColumn(weight, F.col(weight) * F.coalesce(factor, F.lit(1.0))).drop("_sum", "_group")


def group_baseline(df: DataFrame, keys: Sequence[str], group: str, value: str,
                   min_peers: int = dims.MIN_PEERS) -> DataFrame:
    """Median of the group, of the whole date where the group is too thin; and the excess over it."""
    df = df.withColumn("_group", F.coalesce(F.col(group), F.lit("_unknown")))
    own = exact_quantiles(df, [*keys, "_group"], value, {"_own": 0.5}, count="_n")
    every = exact_quantiles(df, list(keys), value, {"_all": 0.5})
    out = df.join(own, [*keys, "_group"], "left").join(every, list(keys), "left")
    base = F.when(F.col("_n") >= min_peers, F.col("_own")).otherwise(F.col("_all"))
    return out.withColumn("baseline", base).withColumn("excess", F.col(value) - F.col("baseline")) \
        .drop("_group", "_own", "_all", "_n")


def max_age(period_type: Column, ages: dict | None = None, default: int = dims.MAX_SIGNAL_AGE_DEFAULT) -> Column:
    out = F.lit(default)
    for name, days in (ages or dims.MAX_SIGNAL_AGE).items():
        out = F.when(period_type == name, days).otherwise(out)
    return out


def eligible(grid: DataFrame, signals: DataFrame, spans: DataFrame, material: DataFrame, momentum: DataFrame | None = None,
             held: DataFrame | None = None, min_momentum_pct: float | None = dims.MOMENTUM_MIN_PCT,
             tie: str = "event_id", oriented: bool = False) -> DataFrame:
    """Latest known signal per (date, symbol) that may still be acted on.

    Kept: members on the date, signals not older than their period allows, without
    a material event since publication, momentum not too negative (unknown is
    fine, and a held symbol is exempt). ``oriented``: momentum counts in the direction the
    gap calls for, so a fall speaks for a negative gap and a rise against it; a gap of
    0 or unknown lets any momentum pass. Option strategies need it, stock ones do not.
    """
    values = [c for c in signals.columns if c not in ("symbol", "published_date")]
    known = asof_join(grid, signals, ["symbol"], "date", "published_date", values, matched="published_date", tie=tie)
    known = known.where("published_date is not null")
    young = F.datediff("date", "published_date") <= max_age(F.col("period_type"))
    out = with_membership(known.where(young), spans, "symbol", "date").where("is_member").drop("is_member")
    out = event_between(out, material, ["symbol"], "published_date", "date", "filed_date", "_stale") \
        .where("not _stale").drop("_stale")
    if momentum is not None and min_momentum_pct is not None:
        out = out.join(momentum.select("symbol", "date", "momentum"), ["symbol", "date"], "left")
        toward = F.col("momentum") * (F.signum("gap_pct") if oriented else F.lit(1))
        ok = F.col("momentum").isNull() | (toward * 100 >= min_momentum_pct)
        if oriented:
            ok = ok | F.col("gap_pct").isNull() | (F.col("gap_pct") == 0)
        if held is not None:
            out = out.join(held.select("symbol", "date", F.lit(True).alias("_held")), ["symbol", "date"], "left")
            ok = ok | F.coalesce("_held", F.lit(False))
        out = out.where(ok).drop("_held")
    return out


# -- strategies -------------------------------------------------------------------------

STRATEGIES: dict[str, Callable[..., DataFrame]] = {}


def strategy(name: str):
    """Register ``f(signals, **params) -> weights``; a name can be taken once."""
    def keep(f):
        if name in STRATEGIES:
            raise ValueError(f"strategy {name!r} is already registered")
        STRATEGIES[name] = f
        return f
    return keep


def settings(explicit: dict, strategy_defaults: dict, fallback: dict) -> dict:
    """Explicit choice over the strategy's default over the general fallback; None counts as unset."""
    out = dict(fallback)
    for layer in (strategy_defaults, explicit):
        out.update({k: v for k, v in layer.items() if v is not None})
    return out


@strategy("valuation_gap")
def long_only_gap(signals: DataFrame, inflation: DataFrame, entry: float = dims.ENTRY_THRESHOLD_PCT,
                  cap_pct: float = dims.POSITION_CAP_PCT, years: float = 1.0) -> DataFrame:
    """Long positions in undervalued symbols, weighted by the inflation-adjusted gap."""
    s = inflation_adjusted(signals, inflation, "gap_pct", "published_date", years)
    return capped_weights(cut(s.where(F.col("adjusted_gap") >= entry)), ["date"], "adjusted_gap", "symbol", cap_pct)


@strategy("sector_neutral")
def sector_neutral(signals: DataFrame, inflation: DataFrame, entry: float = dims.SECTOR_NEUTRAL_ENTRY_PCT,
                   min_gap: float = dims.SECTOR_NEUTRAL_ENTRY_PCT, cap_pct: float = dims.POSITION_CAP_PCT,
                   sector_cap_pct: float = dims.SECTOR_CAP_PCT) -> DataFrame:
    """Long the excess over the sector median, capped per position and per sector."""
    s = inflation_adjusted(signals, inflation, "gap_pct", "published_date", 1.0)
    s = group_baseline(cut(s), ["date"], "sector", "adjusted_gap")
    s = cut(s.where((F.col("excess") >= entry) & (F.col("adjusted_gap") >= min_gap)))
    return cap_by_group(capped_weights(s, ["date"], "excess", "symbol", cap_pct), ["date"], "sector",
                        cap_pct=sector_cap_pct)


@strategy("option_gap")
def option_gap(signals: DataFrame, inflation: DataFrame, entry: float = dims.ENTRY_THRESHOLD_PCT,
               exit_ratio: float = dims.EXIT_THRESHOLD_RATIO, cap_pct: float = dims.POSITION_CAP_PCT,
               conviction_cap: float | None = 100.0, tenor_days: int = dims.TARGET_TENOR_DAYS, basis: str = "log") -> DataFrame:
    """Direction and weight per symbol from the gap; rows over the exit test only carry a direction.

    ``basis``: ``log`` points of value over price, or percent of the ``theoretical`` value or of the ``close``.
    """
    value, price = F.col("theoretical"), F.col("close")
    if basis == "log":
        gap = F.ln(value / price) * 100
    elif basis in ("theoretical", "close"):
        gap = (value - price) / F.col(basis) * 100
    else:
        raise ValueError(f"basis must be log, theoretical or close, not {basis!r}")
    s = signals.where("theoretical > 0 and close > 0").withColumn("gap", gap)
    s = inflation_adjusted(s, inflation, "gap", "published_date", tenor_days / 365.0, log=basis == "log")
    s = threshold_flags(directions(s, "adjusted_gap", conviction_cap), "adjusted_gap", entry, exit_ratio)
    s = cut(s.where("keep"))
    w = capped_weights(s.where("enter"), ["date"], "conviction", "symbol", cap_pct)
    out = s.join(w.select("date", "symbol", "weight"), ["date", "symbol"], "left")
    return out.withColumn("tenor_days", F.lit(tenor_days))


@strategy("option_expected_value")
def option_expected_value(signals: DataFrame, inflation: DataFrame, market: DataFrame, fraction: float = 0.8,
                          criterion: str = "kelly", **params) -> DataFrame:
    """The option targets with the strike of best expected growth; no positive edge, no target.

    ``market`` (date, symbol, sigma, r, q and optionally ``strikes``) is what a
    simulator would ask its market context for, as joined columns.
    """
    from .options import expected_value_strikes
    t = option_gap(signals, inflation, **params).where("enter")
    t = t.join(market, ["date", "symbol"]).withColumns({
        "option_type": F.col("direction"), "spot": F.col("close"), "t": F.col("tenor_days") / 365.0})
    return expected_value_strikes(cut(t), ["date", "symbol"], "strikes" if "strikes" in market.columns else None, fraction, criterion)


def threshold_sweep(signals: DataFrame, keys: Sequence[str], gap: str, order: str, thresholds: Sequence[float],
                    cap_pct: float = dims.POSITION_CAP_PCT) -> DataFrame:
    """Candidates and weight profile for a short list of thresholds in one pass over the signals."""
    per = signals.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    per = per.withColumn("_size", F.abs(F.col(gap))).where(F.col("_size") >= F.col("threshold"))
    w = capped_weights(per, ["threshold", *keys], "_size", order, cap_pct)
    by_group = w.groupBy("threshold", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("invested"), F.max("weight").alias("top"))
    return by_group.groupBy("threshold").agg(
        F.sum("n").alias("candidates"), F.count(F.lit(1)).alias("groups"), F.avg("n").alias("avg_candidates"),
        F.avg("invested").alias("avg_invested"), F.max("top").alias("max_weight"))


def diagnostics(df: DataFrame, label: str) -> DataFrame:
    """How often each provenance or reason occurs."""
    return df.groupBy(F.coalesce(F.col(label), F.lit("none")).alias(label)).agg(F.count(F.lit(1)).alias("n"))
