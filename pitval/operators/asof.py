"""As-of joins that keep every window small.

A classic as-of window holds all rows of one key, so one busy key ends up in one
task. Here the window only ever sees *distinct* (key, day) marks: the probe side
is reduced with ``distinct`` and the fact side has one row per (key, day). A
partition is thus at most two marks per calendar day, whatever the row counts.
The answers go back to the full probe table through a plain equi join on
(key, day), which adaptive execution can split when one key is hot.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stack
from .ordering import segmented_scan


def one_per_mark(df: DataFrame, on: Sequence[str], mark: str, tie: Column | str) -> DataFrame:
    """Last row per (key, mark) by ``tie``; combines map-side, so hot keys shrink first."""
    rest = [c for c in df.columns if c not in (*on, mark)]
    tie = F.col(tie) if isinstance(tie, str) else tie
    return (df.groupBy(*on, mark).agg(F.max_by(F.struct(*rest), tie).alias("_r"))
            .select(*on, mark, "_r.*"))


@dataclass(frozen=True)
class Lookup:
    """One fact table of an as-of lookup: one row per (key, day), or ``tie`` to reduce it."""

    table: DataFrame
    day: str
    values: Sequence[str]
    tolerance_days: int | None = None
    strict: bool = False
    matched: str | None = None
    tie: str | None = None


def asof_lookup(left: DataFrame, on: Sequence[str], left_on: str, lookups: Sequence[Lookup],
                direction: str = "backward") -> DataFrame:
    """Attach to each left row the nearest row of every fact table at or before (after) its day.

    All tables share one window over the marks, so a fallback chain costs no more
    exchanges than a single lookup. ``strict`` excludes the same day; ``matched``
    keeps the day that answered.
    """
    on = list(on)
    probes = left.where(F.col(left_on).isNotNull()).select(*on, F.col(left_on).alias("_mark")).distinct()
    marks, slots = [], []
    for i, look in enumerate(lookups):
        facts = look.table.where(F.col(look.day).isNotNull()).select(
            *on, F.col(look.day).alias("_mark"), *look.values,
            *([look.tie] if look.tie and look.tie not in look.values else []))
        if look.tie:
            facts = one_per_mark(facts, on, "_mark", look.tie)
        # at equal marks a fact comes before the probe, unless strict
        marks.append(facts.select(*on, "_mark", F.lit(2 if look.strict else 0).alias("_side"),
                                  F.struct(F.col("_mark").alias("_at"), *look.values).alias(f"_hit{i}")))
        slots.append(f"_hit{i}")
    marks.append(probes.withColumn("_side", F.lit(1)))
    lined = stack(*marks)
    order = F.col("_mark").asc() if direction == "backward" else F.col("_mark").desc()
    w = Window.partitionBy(*on).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = lined.withColumns({s: F.last(s, ignorenulls=True).over(w) for s in slots}).where("_side = 1")
    out = [F.col(c).alias(f"_k_{c}") for c in on] + [F.col("_mark").alias("_k_mark")]
    for look, slot in zip(lookups, slots):
        near = (F.lit(True) if look.tolerance_days is None else
                F.abs(F.datediff(F.col("_mark"), F.col(f"{slot}._at"))) <= look.tolerance_days)
        if look.matched:
            out.append(F.when(near, F.col(f"{slot}._at")).alias(look.matched))
        out += [F.when(near, F.col(f"{slot}.{v}")).alias(v) for v in look.values]
    found = found.select(*out)
    cond = reduce(lambda a, b: a & b, [F.col(left_on) == F.col("_k_mark")] +
                  [F.col(c) == F.col(f"_k_{c}") for c in on])
    return left.join(found, cond, "left").drop("_k_mark", *[f"_k_{c}" for c in on])


def around(left: DataFrame, on: Sequence[str], left_on: str, right: DataFrame, right_on: str, value: str,
           below: str = "below", above: str = "above") -> DataFrame:
    """Attach the ``value`` of the last mark at or below each row's own mark, and that of the first at or above it.

    For marks that are not days (strikes, prices, amounts), of which one key may have any
    number: marks and different probes are laid out in order once, and a segmented scan
    answers both directions however many ranges a key fills. ``right`` has one row per key
    and mark. A row without a mark, or with a null key, gets nulls. A mark equal to the
    probe's is both below and above.
    """
    on = list(on)
    marks = right.where(F.col(right_on).isNotNull()).select(*on, F.col(right_on).alias("_mark"), F.lit(1).alias("_side"), F.col(value).alias("_value"))
    asked = left.where(F.col(left_on).isNotNull()).select(*on, F.col(left_on).alias("_mark")).distinct()
    lined = stack(marks, asked.withColumn("_side", F.lit(0)), asked.withColumn("_side", F.lit(2)))
    seen = segmented_scan(lined, on, [F.col("_mark"), F.col("_side")], {
        "_below": ("last", F.col("_value")), "_above": ("next", F.col("_value"))}).where("_side <> 1")
    both = seen.groupBy(*on, "_mark").agg(F.max(F.when(F.col("_side") == 2, F.col("_below"))).alias(below),
                                          F.max(F.when(F.col("_side") == 0, F.col("_above"))).alias(above))
    both = both.select(*[F.col(c).alias(f"_k_{c}") for c in on], F.col("_mark").alias("_k_mark"), below, above)
    cond = reduce(lambda a, b: a & b, [F.col(left_on) == F.col("_k_mark")] + [F.col(c) == F.col(f"_k_{c}") for c in on])
    return left.join(both, cond, "left").drop("_k_mark", *[f"_k_{c}" for c in on])


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_on: str, right_on: str,
              values: Sequence[str], tolerance_days: int | None = None, direction: str = "backward",
              strict: bool = False, matched: str | None = None, tie: str | None = None) -> DataFrame:
    """As-of lookup in a single table."""
    look = Lookup(right, right_on, list(values), tolerance_days, strict, matched, tie)
    return asof_lookup(left, on, left_on, [look], direction)


def price_filings(filings: DataFrame, daily: DataFrame, annual: DataFrame | None, symbol: str,
                  filed: str = "filed_date", tolerance_days: int = 10) -> DataFrame:
    """Last daily close within the tolerance, else the last earlier annual close."""
    looks = [Lookup(daily.select(F.col("symbol").alias(symbol), "date", F.col("close").alias("_daily"))
                    .where("_daily is not null"), "date", ["_daily"], tolerance_days)]
    if annual is not None:
        looks.append(Lookup(annual.select(F.col("symbol").alias(symbol), "date", F.col("close").alias("_annual"))
                            .where("_annual is not null"), "date", ["_annual"]))
    out = asof_lookup(filings, [symbol], filed, looks)
    if annual is None:
        out = out.withColumn("_annual", F.lit(None).cast("double"))
    source = F.when(F.col("_daily").isNotNull(), "daily").when(F.col("_annual").isNotNull(), "annual_prior")
    return out.select(*filings.columns, F.coalesce("_daily", "_annual").alias("close"), source.alias("price_source"))


def session_days(calendar: DataFrame, date: str = "date") -> DataFrame:
    """``day, session``: for every calendar day from the first to the last session, the session at or after it.

    One row per calendar day, so an equi join rolls any number of rows, also of a stream. Days
    outside the calendar have no row: what follows the last session is not known yet.
    """
    days = calendar.select(F.to_date(date).alias("session")).where("session is not null").distinct()
    before = F.lag("session").over(Window.orderBy("session"))  # one row per trading day
    since = F.coalesce(F.date_add(before, 1), F.col("session"))
    return days.withColumn("_since", since).select(F.explode(F.sequence("_since", "session")).alias("day"), "session")


def roll_to_session(df: DataFrame, day: str, calendar: DataFrame, out: str = "session", date: str = "date") -> DataFrame:
    """Attach the first trading session at or after a day; null where the calendar does not reach."""
    days = session_days(calendar, date).select(F.col("day").alias("_day"), F.col("session").alias(out))
    return df.join(days, F.to_date(day) == F.col("_day"), "left").drop("_day")


def align(series: DataFrame, calendar: DataFrame, on: Sequence[str], date: str, values: Sequence[str]) -> DataFrame:
    """Carry a series forward onto another calendar (one row per key and calendar day)."""
    return asof_join(calendar, series, on, date, date, values)


def latest_known(grid: DataFrame, events: DataFrame, on: Sequence[str], grid_date: str, event_date: str,
                 values: Sequence[str], tie: str, matched: str | None = None) -> DataFrame:
    """Latest event per key known at each grid day; several on one day resolve by ``tie``."""
    return asof_join(grid, events, on, grid_date, event_date, values, tie=tie, matched=matched)


def event_between(left: DataFrame, events: DataFrame, on: Sequence[str], after: str, upto: str,
                  event_date: str, flag: str = "has_event") -> DataFrame:
    """Is there any event in ``(after, upto]``? The last one up to ``upto`` decides."""
    days = events.select(*on, event_date).distinct()
    out = asof_join(left, days, on, upto, event_date, [], matched="_last_event")
    return (out.withColumn(flag, F.coalesce(F.col("_last_event") > F.col(after), F.lit(False)))
            .drop("_last_event"))


def assign_windows(filings: DataFrame, anchors: DataFrame, on: Sequence[str], filed: str, anchor: str,
                   today: Column) -> DataFrame:
    """Place filings in the windows between consecutive anchor days, the last open to ``today``.

    Both ends of a window are inclusive, so a filing on an anchor day belongs to
    the earlier window; duplicates by accession therefore never arise.
    """
    starts = anchors.select(*on, F.col(anchor).alias("window_start")).where("window_start is not null").distinct()
    w = Window.partitionBy(*on).orderBy("window_start")
    spans = starts.withColumn("window_end", F.coalesce(F.lead("window_start").over(w), today)) \
        .withColumn("_first", F.row_number().over(w) == 1)
    inner = asof_join(filings, spans.drop("_first"), on, filed, "window_start", ["window_end"], strict=True,
                      matched="window_start")
    opening = spans.where("_first").select(*on, F.col("window_start").alias("_s0"), F.col("window_end").alias("_e0"))
    out = inner.join(opening, list(on), "left")
    at_open = F.col("window_start").isNull() & (F.col(filed) == F.col("_s0"))
    return (out.withColumn("window_end", F.when(at_open, F.col("_e0")).otherwise(F.col("window_end")))
            .withColumn("window_start", F.when(at_open, F.col("_s0")).otherwise(F.col("window_start")))
            .where(F.col("window_start").isNotNull() & (F.col(filed) <= F.col("window_end")))
            .drop("_s0", "_e0"))


def preferred_on_day(requests: DataFrame, filings: DataFrame, on: Sequence[str], date: str, forms: Sequence[str],
                     values: Sequence[str], tie: str) -> DataFrame:
    """Exact-day lookup with an ordered preference among forms."""
    rank = F.array_position(F.array(*[F.lit(f) for f in forms]), F.col("form"))
    usable = filings.where(F.col("form").isin(list(forms)))
    best = usable.groupBy(*on, date).agg(
        F.min_by(F.struct("form", *values), F.struct(rank, F.col(tie))).alias("_b"))
    return requests.join(best, [*on, date], "left").select(*requests.columns, "_b.*")
