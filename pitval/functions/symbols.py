"""Symbol, period and sector-name functions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import dims


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), key)


def canonical_symbol(ric: Column, overrides: dict | None = None) -> Column:
    """Override if listed, else the text before the first dot."""
    base = F.substring_index(ric, ".", 1)
    table = dims.SYMBOL_OVERRIDES if overrides is None else overrides
    return F.coalesce(_lookup(table, ric), base) if table else base


def vendor_symbol(symbol: Column, suffix: str = ".us") -> Column:
    """Lower-case vendor form with dashes for class separators."""
    return F.concat(F.translate(F.lower(symbol), " .", "--"), F.lit(suffix))


def fiscal_year(end: Column, cutoff: int = dims.FISCAL_YEAR_CUTOFF_MONTH) -> Column:
    """Year a period end belongs to: an end before the cutoff month closes the previous year."""
    return F.year(end) - F.when(F.month(end) < cutoff, 1).otherwise(0)


def duration_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def in_window(days: Column, window: tuple[int, int]) -> Column:
    """Inclusive window test; an unknown duration never matches."""
    return F.coalesce(days.between(*window), F.lit(False))


def period_key(df: DataFrame) -> Column:
    """Typed composite key; a struct keeps NULL quarters distinct from text."""
    year = F.coalesce(*[F.col(c).cast("int") for c in ("fiscal_year", "year") if c in df.columns])
    return F.struct(F.col("symbol"), F.col("period_type"), year.alias("fiscal_year"), F.col("fiscal_quarter"))


def resolve_sector(df: DataFrame, manual: DataFrame | None = None, cache: DataFrame | None = None,
                   name: str = "instrument_name") -> DataFrame:
    """Manual choice, then the fine financial split, then the cache, then the broad map.

    Unresolved rows keep a NULL sector, so the to-do list is a plain filter.
    """
    financial = F.trim("gics_sector") == "Financials"
    fine = F.when(financial, F.coalesce(_lookup(dims.FINANCIAL_SUB_INDUSTRY, F.trim("gics_sub_industry")),
                                        F.lit("Services financiers")))
    steps = []
    for label, table in (("_manual", manual), ("_cached", cache)):
        if table is not None:
            df = df.join(table.select(F.col("name").alias(name), F.col("sector").alias(label)), name, "left")
        else:
            df = df.withColumn(label, F.lit(None).cast("string"))
    steps = [F.col("_manual"), fine, F.col("_cached"), _lookup(dims.GICS_SECTOR, F.col("gics_sector"))]
    return df.withColumn("sector", F.coalesce(*steps)).drop("_manual", "_cached")
