"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitval.session import keep

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 3; rows with remainder 1 are never learned from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def first_rows(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, the same ones however the input is partitioned: smallest hash of the key first."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(bound)
