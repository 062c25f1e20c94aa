"""Structured Streaming twins of the incremental jobs.

Every sink is idempotent per micro-batch: a batch writes its own ``batch_id``
partition, overwriting what a failed attempt left there, and readers take the
last write per key. Nothing passes through the driver.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.asof import roll_to_session
from ..operators.ordering import keep_last


def read_landed(spark: SparkSession, path: str, schema: str, batch_bytes: int = 1_000_000_000, batch_files: int | None = None) -> DataFrame:
    """Files landing in a folder. A micro-batch is bounded by ``batch_bytes``, or by
    ``batch_files``. How a landing is cut, and the order of its files, must not change what
    the jobs below return: each takes the greatest disorder of event times as ``delay``."""
    reader = spark.readStream.schema(schema)
    if batch_files:
        return reader.option("maxFilesPerTrigger", batch_files).parquet(path)
    return reader.option("maxBytesPerTrigger", batch_bytes).parquet(path)


LATE = "batch_id bigint, rows bigint"


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """``batch_id, rows``: how many rows of each batch of the log at ``path`` came later than the job's delay."""
    try:
        return spark.read.schema(LATE).parquet(f"{path}_late")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LATE)


class _Batches:
    """Writes each micro-batch and notes the late rows of all batches before it.

    A query remembers only its last progress reports, so they are read at every batch: none
    is missed however long the catch-up. Counts go to a table beside the log at once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.query, self.seen, self.late = spark, path, None, -1, 0

    def note(self) -> None:
        for p in self.query.recentProgress if self.query else []:
            if p["batchId"] > self.seen:
                self.seen, n = p["batchId"], sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"])
                if n:
                    self.late += n
                    self.spark.createDataFrame([(p["batchId"], n)], LATE).coalesce(1).write.mode("append").parquet(f"{self.path}_late")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        self.note()
        batch.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", accept_late: bool = False) -> None:
    """Process everything that has landed, then stop; the next call goes on from the checkpoint.

    Fails if a row came later than the job's delay allows, instead of losing it silently,
    and goes on failing: the count stands in ``late_rows``, and later calls refuse to go on
    from a checkpoint that has passed such a row. ``accept_late`` goes on and only counts.
    """
    spark = stream.sparkSession
    before = 0 if accept_late else late_rows(spark, path).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]  # one number
    if before:
        raise RuntimeError(f"{before} rows of earlier batches came later than the delay of the job allows")
    batches = _Batches(spark, path)
    query = batches.query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
                             .trigger(availableNow=True).foreachBatch(batches.write).start())
    query.awaitTermination()
    batches.note()
    if batches.late and not accept_late:
        raise RuntimeError(f"{batches.late} rows came later than the delay of the job allows")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last write per key of a batch log."""
    return keep_last(spark.read.parquet(path), list(keys), "batch_id").drop("batch_id")


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str]) -> None:
    """One row per key, so that readers need not go through the whole log."""
    read_latest(spark, path, keys).write.mode("overwrite").parquet(target)


# -- the jobs ---------------------------------------------------------------------------


def upserts(stream: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Rows to ingest, already reduced to the newest per key over the stream so far."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("r")).select(*keys, "r.*")


def next_session(day: Column) -> Column:
    """Publication on a weekend counts from the next Monday."""
    return F.date_add(day, F.when(F.dayofweek(day) == 7, 2).when(F.dayofweek(day) == 1, 1).otherwise(0))


def latest_signals(stream: DataFrame, key: str, event_time: str, tie: str, values: Sequence[str], calendar: DataFrame | None = None) -> DataFrame:
    """Latest signal per key by (event time, tie); an older one arriving late changes nothing.

    A streaming aggregate: map-side combine shrinks a busy key before its state. With a
    ``calendar`` (``date``: the trading sessions) a signal is known from the first session at
    or after its publication, over weekends, holidays and longer closings alike; the calendar
    is read anew in every micro-batch, so it may grow while the job stands. A signal
    published after the last listed session has no day yet: it gets one with the next write
    of its key, or by ``roll_to_session`` when the log is read. Without a calendar only
    weekends roll.
    """
    newest = F.max(F.struct(F.col(event_time), F.col(tie), *values)).alias("r")
    latest = stream.groupBy(key).agg(newest).select(key, "r.*")
    if calendar is None:
        return latest.withColumn("known_from", next_session(F.to_date(event_time)))
    return roll_to_session(latest, event_time, calendar, "known_from")


def invalidated(signals: DataFrame, events: DataFrame, key: str, published: str, filed: str, life: str, delay: str) -> DataFrame:
    """Signals that meet a material event within their life: an interval semi join of two streams.

    ``filed`` and ``published`` are timestamps; both sides forget rows that no
    longer can match.
    """
    s = signals.withWatermark(published, delay)
    e = events.select(F.col(key).alias("_k"), F.col(filed).alias("_at")).withWatermark("_at", delay)
    within = (F.col(key) == F.col("_k")) & (F.col("_at") > F.col(published)) & \
             (F.col("_at") <= F.col(published) + F.expr(f"interval {life}"))
    return s.join(e, within, "left_semi")


GROUPS = 256


def _in_groups(stream: DataFrame, key: str, groups: int) -> DataFrame:
    """The stream with ``_group``: keys share a state and a call, as a call for each key and batch costs more than its rows."""
    return stream.withColumn("_group", F.pmod(F.hash(key), F.lit(groups)))


NEVER = -(1 << 63) // 1000


def _micros(at: str) -> Column:
    """Microseconds of an event time; a row without one comes before all others."""
    return F.coalesce(F.unix_micros(at), F.lit(NEVER))


def _times(micros: pd.Series) -> pd.Series:
    return pd.to_datetime(micros.where(micros != NEVER), unit="us")


def _pack(rows: pd.DataFrame) -> bytes:
    return pa.ipc.serialize_pandas(rows.reset_index(drop=True), preserve_index=False).to_pybytes()


def _unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.deserialize_pandas(packed)


def _wake(state: GroupState, first: int) -> None:
    """Call again once the watermark has passed ``first`` (microseconds)."""
    state.setTimeoutTimestamp(max(first // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def expired(stream: DataFrame, key: str, event_time: str, tie: str, life_days: int, delay: str, groups: int = GROUPS) -> DataFrame:
    """Signals whose life ended without a successor, as soon as the watermark says so.

    Rows wait in a state until the watermark passes them, so they are taken in event order
    however they arrive. ``groups`` states share the keys by hash; one holds what its keys
    publish within the delay, and all of its rows are taken at once.
    """
    life = life_days * 86_400_000_000

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = pd.concat([*([_unpack(state.get[0])] if state.exists else []), *batches], ignore_index=True)
        waiting = waiting.sort_values(["key", "at", "ident"], ignore_index=True)
        over = waiting["at"] + life < state.getCurrentWatermarkMs() * 1000  # all that could follow within its life has come
        name = waiting["key"].fillna("")
        named = waiting["key"].notna()
        last = (name != name.shift(-1)) | (named != named.shift(-1))
        out = waiting[over & (last | (waiting["at"].shift(-1) > waiting["at"] + life))]
        rest = waiting[~over]
        if len(rest):
            state.update((_pack(rest),))
            _wake(state, int(rest["at"].min()) + life)
        elif state.exists:
            state.remove()
        if len(out):
            yield pd.DataFrame({key: out["key"], tie: out["ident"], "published": _times(out["at"])})

    slim = _in_groups(stream.withWatermark(event_time, delay).select(key, event_time, tie), key, groups).select(
        "_group", F.col(key).alias("key"), event_time, _micros(event_time).alias("at"), F.col(tie).alias("ident"))
    return slim.groupBy("_group").applyInPandasWithState(
        lambda k, batches, state: step(k, (rows[["key", "at", "ident"]] for rows in batches), state),
        f"{key} string, {tie} long, published timestamp", "waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


def first_verdicts(stream: DataFrame, keys: Sequence[str], event_time: str, verdict: str, delay: str) -> DataFrame:
    """One row per key within the watermark; rows without a verdict are left for a retry."""
    return stream.where(F.col(verdict).isNotNull()).withWatermark(event_time, delay) \
        .dropDuplicatesWithinWatermark(list(keys))


def churn_filter(stream: DataFrame, key: str, event_time: str, tie: str, value: str, epsilon: float, delay: str, groups: int = GROUPS) -> DataFrame:
    """Pass a row on only when it moved more than epsilon from the last row passed on.

    Small moves are measured against the last *emitted* value, so a slow drift
    adds up; an unknown value always passes and leaves no reference. Rows wait in a
    state until the watermark passes them and are then taken in event order; ``groups``
    states share the keys by hash, and one holds what its keys publish within the delay and
    their last values. Columns are numbers or strings beside the event time.
    """
    columns = stream.columns
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, held = ([_unpack(x) for x in state.get] if state.exists else (None, None))
        last = {} if known is None else dict(zip(known["key"], known["last"]))
        waiting = pd.concat([*([] if held is None else [held]), *batches], ignore_index=True).sort_values(["_at", tie], ignore_index=True, kind="stable")
        due = waiting["_at"] < state.getCurrentWatermarkMs() * 1000
        ready, passed = waiting[due], []
        for k, v in zip(ready[key], ready[value]):
            before = last.get(k, math.nan)
            passed.append(not abs(v - before) <= epsilon)  # an unknown value, or none before it, compares with nothing
            if passed[-1]:
                last[k] = v
        rest = waiting[~due]
        state.update((_pack(pd.DataFrame({"key": pd.Series(list(last), dtype=object), "last": pd.Series(list(last.values()), dtype=float)})), _pack(rest)))
        if len(rest):
            _wake(state, int(rest["_at"].min()))
        out = ready[passed]
        if len(out):
            yield out.assign(**{event_time: _times(out["_at"])})[columns]

    watched = _in_groups(stream.withWatermark(event_time, delay), key, groups).withColumn("_at", _micros(event_time))
    kept = [*[c for c in columns if c != event_time], "_at"]
    return watched.groupBy("_group").applyInPandasWithState(
        lambda k, batches, state: step(k, (rows[kept] for rows in batches), state),
        types, "last binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


def archive(stream: DataFrame, path: str, checkpoint: str, date: str = "snapshot_date") -> None:
    """Append-only snapshot archive partitioned by date; the newest partition is the current table."""
    query = (stream.writeStream.format("parquet").partitionBy(date).option("path", path)
             .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()


def published_counts(stream: DataFrame, event_time: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Published events per window, tumbling or, with ``slide``, overlapping; late rows within the watermark still count.

    In append mode a window comes out once, when the watermark has passed its end; one that
    is still open has no row yet.
    """
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "n")


def published_sessions(stream: DataFrame, key: str, event_time: str, gap: str, delay: str) -> DataFrame:
    """Runs of events of a key, each less than ``gap`` after the one before, once the watermark has passed their end.

    A row that arrives late but within the watermark may join two runs. The state holds one
    row per open run, whatever its number of events.
    """
    return stream.withWatermark(event_time, delay).groupBy(key, F.session_window(event_time, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
