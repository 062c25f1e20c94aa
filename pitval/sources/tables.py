"""Table scans and sinks: Parquet, CSV, JSON lines, dated archives, run folders."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.symbols import canonical_symbol
from ..operators.ordering import keep_first, keep_last
from ..schema import normalise, require
from ..session import stack


def read_table(spark: SparkSession, path, schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet with a declared schema; only the named columns are read."""
    df = spark.read.schema(schema).parquet(path)
    return df.select(*columns) if columns else df


def read_universe(spark: SparkSession, path: str, exchange: str = "SMART", exchange_map: DataFrame | None = None,
                  overrides: dict | None = None) -> DataFrame:
    """CSV dimension: required columns, one row per canonical symbol, default for an unmapped exchange."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    require(df, ["RIC", "Instrument_Name"])
    df = df.where(F.col("RIC").isNotNull()).withColumn("symbol", canonical_symbol(F.col("RIC"), overrides))
    df = keep_first(df, ["symbol"], [F.col("RIC")])
    raw = F.col("Exchange") if "Exchange" in df.columns else F.lit(None).cast("string")
    if exchange_map is None:
        return df.withColumn("exchange", F.coalesce(raw, F.lit(exchange)))
    codes = exchange_map.select(F.col("exchange").alias("_x"), F.col("code").alias("_code"))
    return (df.join(codes, raw == F.col("_x"), "left")
            .withColumn("exchange", F.coalesce("_code", F.lit(exchange))).drop("_x", "_code"))


def read_preferred_universe(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """The first universe that exists: current and former members preferred over current ones."""
    for path in paths:
        try:
            return read_universe(spark, path, **options)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(", ".join(paths))


def read_archive(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """All dated snapshot files of an archive, columns united by name."""
    return spark.read.option("mergeSchema", True).parquet(*([paths] if isinstance(paths, str) else paths))


def read_log(spark: SparkSession, path: str, schema: str, keys: Sequence[str] | None = None,
             sequence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Append-only JSON lines: (usable rows, unreadable lines). With keys the last write wins."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", f"{schema}, _corrupt string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    full = lines.select(parsed.alias("r")).select("r.*")
    good = full.where("_corrupt is null").drop("_corrupt")
    bad = full.where("_corrupt is not null").select("_corrupt")
    return (keep_last(good, keys, sequence) if keys else good), bad


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append_snapshot(df: DataFrame, archive: str, date: str = "snapshot_date") -> None:
    """One more dated partition in the archive; existing ones stay."""
    df.write.mode("append").partitionBy(date).parquet(archive)


def latest_snapshot(spark: SparkSession, archive: str, date: str = "snapshot_date") -> DataFrame:
    """The rows of the newest partition, found from the partition values alone."""
    df = spark.read.parquet(archive)
    return df.where(F.col(date) == df.agg(F.max(date)).scalar())


def write_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def write_report(tables: dict[str, DataFrame], prefix: str) -> None:
    """Detail, wide summary and raw table of one report, side by side under a prefix."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{prefix}/{name}")


def load_run(spark: SparkSession, root: str, part: str, schema: T.StructType, run_id: str | None = None) -> DataFrame:
    """One part (equity, trades, ...) of the runs under ``root``; an absent part is empty, with its schema."""
    try:
        found = spark.read.parquet(f"{root}/{part}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    df = normalise(found, schema)
    return df.where(F.col("run_id") == run_id) if run_id else df


def latest_run(df: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Rows of the run with the greatest timestamped id."""
    return df.where(F.col(run_id) == df.agg(F.max(run_id)).scalar())


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old and new rows, the new one winning per key."""
    both = stack(old.withColumn("_seq", F.lit(0)), new.withColumn("_seq", F.lit(1)))
    return keep_last(both, keys, "_seq")


def pending(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys still to process."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def refresh_plan(universe: DataFrame, cached: DataFrame, start: Column, today: Column, refresh_days: int) -> DataFrame:
    """Per symbol the day to fetch from, NULL when the cache is fresh enough."""
    last = cached.groupBy("symbol").agg(F.max("date").alias("last_date"))
    age = F.datediff(today, F.col("last_date"))
    return universe.select("symbol").distinct().join(last, "symbol", "left").withColumn(
        "fetch_from", F.when(F.col("last_date").isNull(), start).when(age > refresh_days, F.col("last_date")))


def annual_refresh_plan(universe: DataFrame, cached: DataFrame, start_year: int, end_year: int, today: Column,
                        refresh_days: int) -> DataFrame:
    """Per symbol the first year to fetch; ``universe.requested_from`` remembers earlier requests."""
    known = cached.groupBy("symbol").agg(
        F.max("year").alias("last_year"), F.max(F.when(F.col("year") == end_year, F.col("date"))).alias("closing"))
    first = (F.when(F.col("last_year").isNull(), F.lit(start_year))
             .when(F.lit(start_year) < F.col("requested_from"), F.lit(start_year))
             .when(F.col("last_year") < end_year, F.col("last_year") + 1)
             .when(F.col("closing").isNull() | (F.datediff(today, F.col("closing")) > refresh_days), F.lit(end_year)))
    return universe.join(known, "symbol", "left").withColumn("fetch_from_year", first)


def add_if_absent(universe: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Append rows (the benchmark) whose key is not there yet."""
    fresh = extra.join(universe.select(key).distinct(), key, "left_anti")
    return stack(universe, fresh)
