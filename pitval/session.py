"""Where durable intermediate results go."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine: on a cluster
    another executor could not read it back.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="pitval-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so partition numbers taken in it stay fixed."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the checkpoint root for a written table or a stream."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the query that made them ends, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def keep(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read again: computed once, compressed, and of known size."""
    path = scratch_path(rows.sparkSession, "kept")
    with _tidy(rows.sparkSession):
        rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def stack(*tables: DataFrame) -> DataFrame:
    """Union by name; a column one table lacks is NULL there.

    Spark 4.1 may treat a union of equally partitioned inputs as partitioned that
    way and drop the exchange above it; when exchange reuse then rewrites one
    input, the union is executed as a plain one and rows of a key end up in
    several partitions. Switching that shortcut off keeps every exchange.
    """
    out = tables[0]
    out.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
