"""Multiples, implied prices, discounted cash flows, combined valuation."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import dims
from ..session import cut
from .ordering import exact_quantiles, null_safe_join

MULTIPLES = ("EV/EBITDA", "EV/Sales", "P/E")
COHORT = ("sector", "period_type", "fiscal_year", "fiscal_quarter")


def ratio(a: Column, b: Column) -> Column:
    """NULL instead of a division by zero."""
    return a / F.nullif(b, F.lit(0.0))


def add_multiples(df: DataFrame) -> DataFrame:
    """Market cap, enterprise value and the three multiples; rows need a close and shares."""
    df = df.where("shares_outstanding is not null and close is not null")
    cap = F.col("close") * F.col("shares_outstanding")
    df = df.withColumn("market_cap", cap).withColumn("EV", cap + F.coalesce("net_debt", F.lit(0.0)))
    return df.withColumns({
        "EV/Sales": ratio(F.col("EV"), F.col("revenue")),
        "EV/EBITDA": ratio(F.col("EV"), F.col("ebitda")),
        "P/E": ratio(F.col("close"), ratio(F.col("net_income"), F.col("shares_outstanding"))),
    })


def plausible(column: str, bounds: dict | None = None) -> Column:
    """The multiple if finite, positive and inside its range, else NULL."""
    lo, hi = (bounds or dims.PLAUSIBLE_RANGE).get(column, (0.0, float("inf")))
    c = F.col(f"`{column}`")
    return F.when((c > 0) & (c >= lo) & (c <= hi) & (c < float("inf")), c)


def clean_multiples(df: DataFrame, bounds: dict | None = None) -> DataFrame:
    return df.withColumns({m: plausible(m, bounds) for m in MULTIPLES})


def unpivot_multiples(df: DataFrame, keys: Sequence[str], columns: Sequence[str] = MULTIPLES) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("multiple"), F.col(f"`{m}`").cast("double").alias("value")) for m in columns
    ])).alias("_m")).select(*keys, "_m.*")


def group_statistics(df: DataFrame, keys: Sequence[str] = ("sector",),
                     columns: Sequence[str] = MULTIPLES) -> DataFrame:
    """Mean, median, min, max, sample deviation and count of positive values per (group, multiple)."""
    keys = list(keys)
    long = cut(unpivot_multiples(df.where(F.col(keys[0]).isNotNull()), keys, columns))  # read three times
    every = long.select(*keys, "multiple").distinct()
    positive = long.where("value > 0")
    moments = positive.groupBy(*keys, "multiple").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.stddev_samp("value").alias("std"), F.count("value").alias("n"))
    medians = exact_quantiles(positive, [*keys, "multiple"], "value", {"median": 0.5})
    out = null_safe_join(null_safe_join(every, moments, [*keys, "multiple"]), medians, [*keys, "multiple"])
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def wide_statistics(stats: DataFrame, key: str = "sector", stat: Sequence[str] = ("mean", "median"),
                    columns: Sequence[str] = MULTIPLES) -> DataFrame:
    """Long statistics to one row per group, with the pivot values given up front."""
    return stats.groupBy(key).pivot("multiple", list(columns)).agg(*[F.first(s).alias(s) for s in stat])


def cohort_medians(df: DataFrame, cohort: Sequence[str] = COHORT, min_peers: int = dims.MIN_PEERS) -> DataFrame:
    """Whole-cohort median per multiple, NULL under ``min_peers``, with the peer count."""
    long = cut(unpivot_multiples(clean_multiples(df.where("sector is not null")), cohort))  # read twice
    keys = [*cohort, "multiple"]
    every = long.select(*keys).distinct()
    q = exact_quantiles(long, keys, "value", {"median": 0.5}, count="n_peers")
    out = null_safe_join(every, q, keys).withColumn("n_peers", F.coalesce("n_peers", F.lit(0)))
    return out.withColumn("median", F.when(F.col("n_peers") >= min_peers, F.col("median")))


def _median_of(values: Column) -> Column:
    s = F.array_sort(F.array_compact(values))
    n = F.size(s)
    lo = F.try_element_at(s, F.floor((n + 1) / 2).cast("int"))
    hi = F.try_element_at(s, F.floor(n / 2 + 1).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)


def implied_prices(df: DataFrame, applicable: DataFrame | None = None) -> DataFrame:
    """Price per share implied by each peer median, and their row-wise median and count.

    ``df`` carries ``<multiple>_median`` and ``<multiple>_n_peers``; ``applicable``
    (sector, applicable) names the multiples that make sense for a sector.
    """
    shares, debt = F.col("shares_outstanding"), F.col("net_debt")

    def from_ev(median: str, metric: str) -> Column:
        price = (F.col(f"`{median}`") * F.col(metric) - debt) / F.when(shares > 0, shares)
        return F.when(F.col(metric) > 0, price)

    earnings = F.when((F.col("net_income") > 0) & (shares > 0),
                      F.col("`P/E_median`") * (F.col("net_income") / F.nullif(shares, F.lit(0.0))))
    prices = {"price_from_ev_ebitda": ("EV/EBITDA", from_ev("EV/EBITDA_median", "ebitda")),
              "price_from_ev_sales": ("EV/Sales", from_ev("EV/Sales_median", "revenue")),
              "price_from_pe": ("P/E", earnings)}
    default = F.array(*[F.lit(m) for m in dims.SECTOR_MULTIPLES_DEFAULT])
    if applicable is not None:
        df = df.join(F.broadcast(applicable), "sector", "left")
        allowed = F.coalesce("applicable", default)
    else:
        allowed = default
    df = df.withColumns({name: F.when(F.array_contains(allowed, F.lit(m)), p) for name, (m, p) in prices.items()})
    values = F.array(*[F.col(c) for c in prices])
    df = df.withColumns({
        "valuation_multiples_per_share": _median_of(values),
        "n_multiples_used": F.size(F.array_compact(values)),
        "n_peers": F.greatest(*[F.col(f"`{m}_n_peers`") for m in MULTIPLES]),
    })
    return df.drop("applicable") if applicable is not None else df


def fallback_filed_date(df: DataFrame, filed: str = "filed_date", year: str = "year") -> DataFrame:
    """A filing without a date counts as known on April 1 of the next year."""
    return (df.withColumn("filed_date_estimated", F.col(filed).isNull())
            .withColumn(filed, F.coalesce(F.col(filed), F.make_date(F.col(year) + 1, F.lit(4), F.lit(1)))))


def known_by(df: DataFrame, as_of, known_date: str = "filed_date") -> DataFrame:
    """Only rows published by ``as_of``; the filter reaches the scan."""
    return df.where(F.col(known_date) <= F.lit(as_of).cast("date"))


def annual_known_by(df: DataFrame, as_of, year: str = "year") -> DataFrame:
    """Annual rows count as known from December 31 of their year."""
    return df.where(F.make_date(F.col(year), F.lit(12), F.lit(31)) <= F.lit(as_of).cast("date"))


def gap_pct(value: Column, base: Column, over: Column | None = None) -> Column:
    return (value - base) / F.nullif(over if over is not None else base, F.lit(0.0)) * 100


def log_gap(value: Column, price: Column) -> Column:
    return F.when((value > 0) & (price > 0), F.ln(value / price) * 100)


def log_points_to_pct(points: Column) -> Column:
    return F.expm1(points / 100) * 100


def pct_to_log_points(pct: Column) -> Column:
    return F.log1p(pct / 100) * 100


def sector_assumptions(df: DataFrame, params: DataFrame, rates: DataFrame, date: str = "filed_date",
                       sector: str = "sector") -> DataFrame:
    """WACC and growth by sector, WACC following the rate known then, with a floor over terminal growth."""
    wacc, growth, terminal = dims.SECTOR_DCF_DEFAULT
    p = params.withColumnRenamed("sector", sector)
    out = df.join(F.broadcast(p), sector, "left")
    out = out.withColumns({"wacc": F.coalesce("wacc", F.lit(wacc)), "fcf_growth": F.coalesce("fcf_growth", F.lit(growth)),
                           "terminal_growth": F.coalesce("terminal_growth", F.lit(terminal))})
    known = rates.select((F.col("year") + 1).alias("_known_in"), F.col("rate").alias("_rate"))
    out = out.join(F.broadcast(known), F.year(date) == F.col("_known_in"), "left")
    followed = F.greatest(F.coalesce("_rate", F.lit(dims.RISK_FREE_DEFAULT)) + (F.col("wacc") - dims.WACC_CALIBRATION_RATE),
                          F.col("terminal_growth") + dims.MIN_WACC_SPREAD)
    return (out.withColumn("wacc", F.when(F.col(date).isNull(), F.col("wacc")).otherwise(followed))
            .drop("_known_in", "_rate"))


def dcf_values(df: DataFrame, years: int = 5, default_tax: float = 0.21,
               excluded: Sequence[str] = dims.SECTORS_WITHOUT_DCF) -> DataFrame:
    """Free cash flow to the firm, its discounted value per share, and why a row has none.

    Needs ebit, tax_rate, da, capex, working_capital_change, net_debt,
    shares_outstanding, close and the columns of ``sector_assumptions``.
    """
    tax = F.when(F.col("tax_rate").between(0, 1) & (F.col("tax_rate") < 1), F.col("tax_rate")).otherwise(default_tax)
    fcf = (F.col("ebit") * (1 - tax) + F.coalesce("da", F.lit(0.0)) - F.col("capex")
           - F.coalesce("working_capital_change", F.lit(0.0)))
    growth, wacc, end = F.col("fcf_growth"), F.col("wacc"), F.col("terminal_growth")
    flows = F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.lit(0.0),
                        lambda acc, t: acc + F.col("fcf") * F.pow(1 + growth, t) / F.pow(1 + wacc, t))
    last = F.col("fcf") * F.pow(1 + growth, F.lit(years))
    terminal = last * (1 + end) / F.when(wacc > end, wacc - end) / F.pow(1 + wacc, F.lit(years))
    df = df.withColumn("fcf", fcf)
    reason = (F.when(F.col("sector").isin(list(excluded)), "sector_without_dcf")
              .when(F.col("ebit").isNull(), "ebit_missing")
              .when(F.col("ebit") <= 0, "ebit_not_positive")
              .when(F.col("shares_outstanding").isNull() | (F.col("shares_outstanding") <= 0), "shares_missing")
              .when(F.col("fcf") <= 0, "fcf_not_positive")
              .when(wacc <= end, "wacc_not_above_growth")
              .when(F.col("fcf").isNull() | F.col("net_debt").isNull(), "input_missing"))
    df = df.withColumn("reason", reason)
    ev = flows + terminal
    df = df.withColumn("valuation_dcf_per_share",
                       F.when(F.col("reason").isNull(), (ev - F.col("net_debt")) / F.col("shares_outstanding")))
    return df.withColumn("gap_pct", gap_pct(F.col("valuation_dcf_per_share"), F.col("close")))


def rejection_counts(valued: DataFrame) -> DataFrame:
    """Rows per rejection reason and their share of all rows."""
    by = valued.groupBy(F.coalesce("reason", F.lit("valued")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    # one row per reason: the whole-table window sees a handful of rows
    return by.withColumn("share_pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))))


def combine(valued: DataFrame) -> DataFrame:
    """Multiples first, DCF as the fallback; rows need a value and a close."""
    m, d = F.col("valuation_multiples_per_share"), F.col("valuation_dcf_per_share")
    out = valued.withColumns({
        "valuation_theoretical_per_share": F.coalesce(m, d),
        "source": F.when(m.isNotNull(), "multiples").when(d.isNotNull(), "dcf_fallback"),
    }).where("valuation_theoretical_per_share is not null and close is not null")
    return out.withColumn("gap_pct", gap_pct(F.col("valuation_theoretical_per_share"), F.col("close")))


def signal_events(valued: DataFrame, value: str, close_as: str = "close") -> DataFrame:
    """Publication events: filing date becomes published date, fiscal year defaults to year."""
    year = [F.col(c) for c in ("fiscal_year", "year") if c in valued.columns]
    keep = [c for c in ("source", "gap_pct", "period_type") if c in valued.columns]
    return valued.select("symbol", F.col("filed_date").alias("published_date"), F.coalesce(*year).alias("fiscal_year"),
                         "sector", F.col("close").alias(close_as), F.col(value).alias("valuation"), *keep)
