"""Membership spans: built from an event log, probed at a date."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stack
from .asof import asof_join
from .ordering import ranked

OPEN_START = "0001-01-01"


def spans_from_events(events: DataFrame, current: DataFrame) -> DataFrame:
    """Event log (ticker, date, action, seq) and current members -> half-open spans.

    Each ``added`` opens a span that ends at the next event; a ``removed`` that
    follows no ``added`` means membership from before the log; a current member
    whose last event is no ``added`` (or who has none) has an open span from its
    listed date. Neighbours are found by an equi join on position, not by a
    window over the whole ticker.
    """
    log = ranked(events.select("ticker", "date", "action", "seq"), ["ticker"], [F.col("date"), F.col("seq")])
    after = log.select("ticker", (F.col("pos") - 1).alias("pos"), F.col("date").alias("next_date"))
    before = log.select("ticker", (F.col("pos") + 1).alias("pos"), F.col("action").alias("prev_action"))
    opened = (log.where("action = 'added'").join(after, ["ticker", "pos"], "left")
              .select("ticker", F.col("date").alias("start_date"), F.col("next_date").alias("end_date")))
    orphan = (log.where("action = 'removed'").join(before, ["ticker", "pos"], "left")
              .where("coalesce(prev_action, '') <> 'added'")
              .select("ticker", F.lit(None).cast("date").alias("start_date"), F.col("date").alias("end_date")))
    last = log.groupBy("ticker").agg(F.max_by("action", "pos").alias("last_action"))
    members = current.select("ticker", "company_name", "date_added").dropDuplicates(["ticker"])
    still = (members.join(last, "ticker", "left").where("coalesce(last_action, '') <> 'added'")
             .select("ticker", F.col("date_added").alias("start_date"), F.lit(None).cast("date").alias("end_date")))
    spans = stack(opened, orphan, still)
    named = spans.join(members.select("ticker", "company_name", F.lit(True).alias("is_current_member")),
                       "ticker", "left")
    return named.select("ticker", F.coalesce("company_name", "ticker").alias("company_name"),
                        "start_date", "end_date",
                        F.coalesce("is_current_member", F.lit(False)).alias("is_current_member"))


def membership_steps(spans: DataFrame, key: str) -> DataFrame:
    """Spans of any number and overlap -> one row per (key, day) with the open count from then on."""
    floor_day = F.lit(OPEN_START).cast("date")
    opens = spans.select(key, F.coalesce("start_date", floor_day).alias("date"), F.lit(1).alias("delta"))
    closes = spans.where("end_date is not null").select(key, F.col("end_date").alias("date"), F.lit(-1).alias("delta"))
    known = spans.select(key, floor_day.alias("date"), F.lit(0).alias("delta")).distinct()
    steps = stack(opens, closes, known).groupBy(key, "date").agg(F.sum("delta").alias("delta"))
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(key, "date", F.sum("delta").over(w).alias("open_spans"))


def with_membership(left: DataFrame, spans: DataFrame, key: str, date: str, span_key: str | None = None,
                    unknown_is_member: bool = False, flag: str = "is_member") -> DataFrame:
    """Flag rows whose key is a member on their date (``start <= d < end``, NULL = open)."""
    steps = membership_steps(spans.withColumnRenamed(span_key, key) if span_key else spans, key)
    out = asof_join(left, steps.withColumnRenamed("date", "_step"), [key], date, "_step", ["open_spans"])
    member = F.when(F.col("open_spans").isNull(), F.lit(unknown_is_member)).otherwise(F.col("open_spans") > 0)
    return out.withColumn(flag, member).drop("open_spans")


def members_at(spans: DataFrame, key: str, day) -> DataFrame:
    """Keys that are members on one given day."""
    d = F.lit(day).cast("date")
    inside = (F.col("start_date").isNull() | (F.col("start_date") <= d)) & (
        F.col("end_date").isNull() | (F.col("end_date") > d))
    return spans.where(inside).select(key).distinct()


def full_universe(spans: DataFrame, country: str = "United States", currency: str = "USD",
                  exchange: str = "SMART") -> DataFrame:
    """Current and former members, one row each, the current name preferred."""
    best = spans.groupBy(F.col("ticker").alias("ric")).agg(
        F.max_by(F.struct("company_name"), F.struct("is_current_member", "company_name")).alias("r"))
    return best.select("ric", F.col("r.company_name").alias("instrument_name"), F.lit(country).alias("country"),
                       F.lit(currency).alias("currency"), F.lit(exchange).alias("exchange"))


def sector_at(df: DataFrame, changes: Sequence[tuple], symbol: str = "symbol", sector: str = "sector",
              date: str = "filed_date", out: str = "sector_asof") -> DataFrame:
    """Undo reclassifications newest first for rows dated before them.

    ``changes`` is a short list of (effective date, {symbol: sector before},
    {sector after: sector before}); a symbol move wins over a whole-sector move.
    """
    df = df.withColumn(out, F.col(sector))
    for effective, moves, sector_moves in sorted(changes, key=lambda c: c[0], reverse=True):
        before = F.lit(None).cast("string")
        if sector_moves:
            pairs = [x for k, v in sector_moves.items() for x in (F.lit(k), F.lit(v))]
            before = F.try_element_at(F.create_map(*pairs), F.col(out))
        if moves:
            pairs = [x for k, v in moves.items() for x in (F.lit(k), F.lit(v))]
            before = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(symbol)), before)
        applies = F.col(date) < F.lit(effective).cast("date")
        df = df.withColumn(out, F.when(applies & F.col(out).isNotNull(), F.coalesce(before, F.col(out)))
                           .otherwise(F.col(out)))
    return df
