"""Reported facts to one value per entity, metric and period."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import dims
from ..functions.symbols import duration_days, fiscal_year, in_window
from ..session import stack
from .asof import asof_join

LAST_DAY = "9999-12-31"


def tagged(facts: DataFrame, tags: DataFrame) -> DataFrame:
    """Facts that carry a known tag, with metric, priority and kind (fixed-size tag table)."""
    return facts.join(F.broadcast(tags), ["namespace", "tag"])


def annual_facts(facts: DataFrame, forms: Sequence[str] = ("10-K",)) -> DataFrame:
    """Annual-report facts labelled with their fiscal year; a flow must span about a year."""
    f = facts.where(F.col("form").isin(list(forms)) & F.col("val").isNotNull() & F.col("end").isNotNull())
    annual = in_window(duration_days(F.col("start"), F.col("end")), dims.ANNUAL_DAYS)
    return f.where(~F.col("is_flow") | annual).withColumn("fiscal_year", fiscal_year(F.col("end")))


def snap_cover_page(facts: DataFrame, keys: Sequence[str] = ("cik",)) -> DataFrame:
    """Cover-page counts belong to the latest period end observed on or before their date."""
    ends = annual_facts(facts.where("not cover_page")).select(*keys, "end").distinct()
    cover = facts.where("cover_page and form = '10-K'")
    snapped = asof_join(cover, ends.withColumnRenamed("end", "_period"), list(keys), "end", "_period", [],
                        matched="period_end")
    return snapped.withColumn("fiscal_year", fiscal_year(F.col("period_end"))).where("fiscal_year is not null")


def first_published(facts: DataFrame, keys: Sequence[str], tie: str = "seq") -> DataFrame:
    """Best tag first, then the earliest publication: what was known when the year was new."""
    filed = F.coalesce("filed", F.lit(LAST_DAY).cast("date"))
    return facts.groupBy(*keys).agg(
        F.min_by(F.struct("val", "filed"), F.struct("priority", filed, tie)).alias("r")).select(*keys, "r.*")


def latest_published(facts: DataFrame, keys: Sequence[str], window: tuple[int, int] | None = None,
                     tie: str = "seq") -> DataFrame:
    """The last filing wins; with a window, entries of that duration win over any other."""
    fits = in_window(F.col("days"), window) if window else F.lit(True)
    return facts.groupBy(*keys).agg(
        F.max_by(F.struct("val", "filed", fits.alias("fits")), F.struct(fits, F.col("filed"), F.col(tie))).alias("r")) \
        .select(*keys, "r.*")


def owned_by_best_tag(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only the entries of the best tag that reports a period at all."""
    best = facts.groupBy(*keys).agg(F.min("priority").alias("priority"))
    return facts.join(best, [*keys, "priority"])


def wide_periods(values: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per period, a column per metric, known once the last of them was filed."""
    return values.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("val"))).alias(m) for m in metrics],
        F.max("filed").alias("filed_date"))


def annual_table(facts: DataFrame, tags: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Long facts to the annual fundamentals table."""
    known = tagged(facts, tags)
    plain = annual_facts(known.where("not cover_page"))
    cover = snap_cover_page(known)
    every = stack(plain, cover)
    values = first_published(every, ["cik", "metric", "fiscal_year"], "accn")
    return wide_periods(values, ["cik", "fiscal_year"], list(metrics or dims.FACT_TAGS))


def discrete_quarters(periods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Year-to-date figures to single quarters.

    ``periods`` has one row per (keys, fiscal_year, fp) with ``val``, ``filed``,
    ``end`` and ``direct`` (the figure already covers one quarter only). A
    cumulative figure loses the quarters before it, the fourth is the year less
    the other three; NULL if one of those is missing, known when the last is filed.
    """
    keys = list(keys)

    def slot(fp: str) -> Column:
        return F.max(F.when(F.col("fp") == fp, F.struct("val", "filed", "end", "direct")))

    year = periods.groupBy(*keys, "fiscal_year").agg(*[slot(fp).alias(fp) for fp in ("Q1", "Q2", "Q3", "FY")])

    def value(c: Column, before: list[str]) -> Column:
        rest = c["val"]
        for b in before:
            rest = rest - F.col(f"{b}v")
        return rest

    def filed(c: Column, before: list[str]) -> Column:
        return F.greatest(c["filed"], *[F.col(f"{b}f") for b in before]) if before else c["filed"]

    for name, source, before in (("Q1", "Q1", []), ("Q2", "Q2", ["Q1"]), ("Q3", "Q3", ["Q1", "Q2"]),
                                 ("Q4", "FY", ["Q1", "Q2", "Q3"])):
        c = F.col(source)
        direct = c["direct"] if name != "Q4" else F.lit(False)
        year = year.withColumn(f"{name}v", F.when(direct, c["val"]).otherwise(value(c, before)))
        year = year.withColumn(f"{name}f", F.when(F.col(f"{name}v").isNull(), None)
                               .when(direct, c["filed"]).otherwise(filed(c, before)))
    rows = F.explode(F.array(*[
        F.struct(F.lit(q).alias("fiscal_quarter"), F.col(f"{q}v").alias("val"), F.col(f"{q}f").alias("filed_date"),
                 F.col("FY" if q == "Q4" else q)["end"].alias("period_end")) for q in ("Q1", "Q2", "Q3", "Q4")]))
    return year.select(*keys, "fiscal_year", rows.alias("q")).select(*keys, "fiscal_year", "q.*").where("val is not null")


DRIFT = 10  # days by which a period of whole weeks may end before or after its month does


def _period_month(end: Column) -> Column:
    """Months since year 0 of the month a period end stands for: a 52/53-week year closes some days beside its month's end."""
    near = F.date_sub(end, DRIFT)
    return F.year(near) * 12 + F.month(near) - 1


def _spans(days: Column, quarters: Column) -> Column:
    """Does a duration cover so many quarters?"""
    return F.abs(days - 91 * quarters) <= 20


def fiscal_months(facts: DataFrame, keys: Sequence[str] = ("cik",)) -> DataFrame:
    """``keys, fiscal_month``: the month each company's year ends in, as most of its flow facts tell.

    A fact votes if it covers one quarter, or all quarters of the period its report names; its
    end and the quarters still to come give the year's last month. Comparatives of the same
    period agree, and facts of other lengths have no vote. Ties go to the later month.
    """
    n = F.when(F.col("fp") == "FY", 4).otherwise(F.substring("fp", 2, 1).cast("int"))
    days = duration_days(F.col("start"), F.col("end"))
    votes = facts.where(F.col("fp").isin("Q1", "Q2", "Q3", "FY") & (_spans(days, n) | (n < 4) & in_window(days, dims.QUARTER_DAYS)))
    month = (_period_month(F.col("end")) + 3 * (4 - n)) % 12 + 1
    counted = votes.groupBy(*keys, month.alias("fiscal_month")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.max_by("fiscal_month", F.struct("n", "fiscal_month")).alias("fiscal_month"))


def in_fiscal_calendar(facts: DataFrame, keys: Sequence[str] = ("cik",)) -> DataFrame:
    """Facts with the fiscal year and period (``fp``) that their own end and duration name.

    A report names the year and period of its newest figures only; comparatives and events
    after the period carry the same names. So each fact is placed by its end in the company's
    fiscal calendar: it must end within ``DRIFT`` days of a quarter's last month, and cover one
    quarter, the year to date, or (``FY``) the year. Facts of other ends or lengths belong
    to no period and go, whatever else their report holds. Companies whose facts tell no
    calendar have no periods.
    """
    f = facts.join(fiscal_months(facts, keys), list(keys))
    at, end = _period_month(F.col("end")), F.col("end")
    month_end = F.last_day(F.make_date(F.floor(at / 12).cast("int"), (at % 12 + 1).cast("int"), F.lit(1)))
    left = (F.col("fiscal_month") - 1 - at % 12 + 12) % 12  # months to the year's end
    q = 4 - left / 3
    days = duration_days(F.col("start"), end)
    year_at = at + left
    year = F.floor(year_at / 12) - F.when(year_at % 12 + 1 < dims.FISCAL_YEAR_CUTOFF_MONTH, 1).otherwise(0)
    fits = F.when(left == 0, in_window(days, dims.ANNUAL_DAYS)).otherwise(in_window(days, dims.QUARTER_DAYS) | _spans(days, q))
    fp = F.when(left == 0, "FY").otherwise(F.concat(F.lit("Q"), q.cast("int").cast("string")))
    return (f.where((left % 3 == 0) & (F.abs(F.datediff(end, month_end)) <= DRIFT) & fits)
            .withColumns({"fiscal_year": year.cast("int"), "fp": fp}).drop("fiscal_month"))


def quarterly_flows(facts: DataFrame, keys: Sequence[str] = ("cik", "metric")) -> DataFrame:
    """Flow facts (with priority) to discrete quarters: owner tag, quarter-length entries first, latest filing.

    Periods go by the end and the length of each entry in the company's own fiscal calendar,
    so neither a comparative nor an event after the period replaces or hides a figure.
    """
    f = facts.where(F.col("form").isin("10-Q", "10-K") & F.col("val").isNotNull() & F.col("end").isNotNull() & F.col("start").isNotNull())
    f = in_fiscal_calendar(f).withColumn("days", duration_days(F.col("start"), F.col("end")))
    period = [*keys, "fiscal_year", "fp"]
    # a period other than the year prefers a stand-alone quarter
    short = in_window(F.col("days"), dims.QUARTER_DAYS)
    # the best tag that reports a period owns it: it leads the order, so the facts need not meet themselves in a join
    best = f.where(F.col("priority").isNotNull()).groupBy(*period).agg(F.max_by(
        F.struct("val", "filed", "end", short.alias("direct")), F.struct(-F.col("priority"), short, F.col("filed"), F.col("accn"))).alias("r"))
    return discrete_quarters(best.select(*period, "r.*"), keys)
