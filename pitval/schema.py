"""Explicit table schemas, required-column contract and normalisation on read."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

PRICES = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

EQUITY_CURVE = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("nav", T.DoubleType()),
    T.StructField("cash", T.DoubleType()),
    T.StructField("invested_value", T.DoubleType()),
    T.StructField("num_positions", T.LongType()),
])

TRADES = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("symbol", T.StringType()),
    T.StructField("entry_date", T.DateType()),
    T.StructField("exit_date", T.DateType()),
    T.StructField("shares", T.DoubleType()),
    T.StructField("entry_price", T.DoubleType()),
    T.StructField("exit_price", T.DoubleType()),
    T.StructField("option_type", T.StringType()),
    T.StructField("exit_reason", T.StringType()),
])

EXECUTIONS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("date", T.DateType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("side", T.StringType()),
    T.StructField("option_type", T.StringType()),
    T.StructField("contracts", T.DoubleType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("multiplier", T.DoubleType()),
    T.StructField("reason", T.StringType()),
    T.StructField("commission", T.DoubleType()),
    T.StructField("slippage", T.DoubleType()),
])

_FACT = T.StructType([
    T.StructField("accn", T.StringType()),
    T.StructField("start", T.StringType()),
    T.StructField("end", T.StringType()),
    T.StructField("filed", T.StringType()),
    T.StructField("form", T.StringType()),
    T.StructField("fy", T.IntegerType()),
    T.StructField("fp", T.StringType()),
    T.StructField("val", T.DoubleType()),
])

# entity document: namespace -> tag -> units -> facts
COMPANY_FACTS = T.StructType([
    T.StructField("cik", T.StringType()),
    T.StructField("facts", T.MapType(T.StringType(), T.MapType(
        T.StringType(),
        T.StructType([T.StructField("units", T.MapType(T.StringType(), T.ArrayType(_FACT)))]),
    ))),
])

FILING_INDEX = T.StructType([
    T.StructField("accession", T.ArrayType(T.StringType())),
    T.StructField("form", T.ArrayType(T.StringType())),
    T.StructField("filed", T.ArrayType(T.StringType())),
])


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail early, on the driver, when a table misses columns an operator needs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def number(column: Column | str) -> Column:
    """Double with NaN turned into NULL, so there is one kind of missing value."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(c), c)


def day(column: Column | str) -> Column:
    """Naive calendar day; text that is no date becomes NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return c.try_cast("date")


def compact_day(column: Column | str) -> Column:
    """``yyyyMMdd`` text as a date, NULL when it is none."""
    c = F.col(column) if isinstance(column, str) else column
    return F.try_to_timestamp(c, F.lit("yyyyMMdd")).cast("date")


def normalise(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to ``schema``, add absent nullable columns, refuse absent keys."""
    require(df, [f.name for f in schema if not f.nullable])
    out = []
    for field in schema:
        if field.name not in df.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif isinstance(field.dataType, T.DoubleType):
            out.append(number(field.name).alias(field.name))
        elif isinstance(field.dataType, T.DateType):
            out.append(day(field.name).alias(field.name))
        else:
            out.append(F.col(field.name).cast(field.dataType).alias(field.name))
    return df.select(*out)
