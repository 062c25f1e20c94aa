"""Dense price panel in long form: calendar positions, bounded fill, returns, momentum, volatility.

After ``dense`` a symbol has one row per calendar day, so every window below is
bounded by the calendar.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import dims


def calendar(prices: DataFrame) -> DataFrame:
    """Distinct days with their position. One row per day: the unpartitioned window stays tiny."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    days = prices.select("date").distinct()
    return days.select("date", (F.row_number().over(w) - 1).alias("pos"),
                       F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("days"))


def dense(prices: DataFrame, limit: int = dims.FILL_LIMIT_ROWS) -> DataFrame:
    """One row per (calendar day, symbol); a close is carried at most ``limit`` rows, an open never.

    Each price row emits itself and the empty days up to the symbol's next row,
    which is linear in the output and needs no product of days and symbols.
    ``last_valid_date`` is the day of the last real close.
    """
    cal = calendar(prices)
    real = prices.where("close is not null").join(F.broadcast(cal), "date")
    w = Window.partitionBy("symbol").orderBy("pos")
    placed = real.select("symbol", "date", "close", "open", "pos",
                         F.coalesce(F.lead("pos").over(w), F.col("days")).alias("until"),
                         (F.row_number().over(w) == 1).alias("first"))
    begin = F.when(F.col("first"), F.lit(0)).otherwise(F.col("pos"))
    rows = placed.withColumn("at", F.explode(F.sequence(begin, F.col("until") - 1)))
    age = F.col("at") - F.col("pos")
    return (rows.select("symbol", "at", F.when((age >= 0) & (age <= limit), F.col("close")).alias("close"),
                        F.when(age == 0, F.col("open")).alias("open"),
                        F.when(age >= 0, F.col("date")).alias("last_valid_date"), (age == 0).alias("is_real"))
            .withColumnRenamed("at", "pos").join(F.broadcast(cal.select("date", "pos")), "pos"))


def _by_symbol():
    return Window.partitionBy("symbol").orderBy("pos")


def returns(panel: DataFrame) -> DataFrame:
    """Simple and log return against the previous panel day; NULL if either close is."""
    before = F.lag("close").over(_by_symbol())
    return panel.withColumns({"ret": F.col("close") / F.nullif(before, F.lit(0.0)) - 1,
                              "log_ret": F.when((F.col("close") > 0) & (before > 0), F.ln("close") - F.ln(before))})


def momentum(panel: DataFrame, skip: int = 21, lookback: int = 252) -> DataFrame:
    """Return over ``lookback`` rows leaving out the last ``skip``; NULL if the history is short."""
    w = _by_symbol()
    start, end = F.lag("close", lookback).over(w), F.lag("close", skip).over(w)
    return panel.withColumn("momentum", F.when(start > 0, end / start - 1))


def realized_vol(panel: DataFrame, lookback: int = 60) -> DataFrame:
    """Annualised deviation of up to lookback-1 log returns over the non-missing closes."""
    w = _by_symbol()
    known = panel.where("close is not null").withColumns(
        {"_lr": F.ln("close") - F.ln(F.lag("close").over(w)), "_n": F.row_number().over(w)})
    frame = w.rowsBetween(-(lookback - 2), 0)
    enough = (F.count("_lr").over(frame) >= 5) & (F.col("_n") >= max(lookback // 2, 10))
    return known.withColumn("realized_vol", F.when(enough, F.stddev_samp("_lr").over(frame) * F.sqrt(F.lit(252.0)))) \
        .drop("_lr", "_n")


def equal_weight_index(member_returns: DataFrame) -> DataFrame:
    """Daily mean of member returns compounded from 1; a day without any counts as 0."""
    daily = member_returns.groupBy("date").agg(F.avg(F.when(F.col("is_member"), F.col("ret"))).alias("mean_ret"))
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("level", F.product(1 + F.coalesce("mean_ret", F.lit(0.0))).over(w))
