"""Streaming jobs replayed over the event table: it lands in three parts, each processed as it arrives."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path, stack
from ..sources import tables as src
from ..streaming import jobs
from .bindings import VIEWS, View, raw
from .registry import Book

book = Book()
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
DELAY = "11 days"  # a part spans up to ten days (eleven after the 20th), and its files come in any order
BEAT = "heartbeat"


def parts(spark, sf):
    """The events in event-time order, cut at the 10th and 20th of the month."""
    e = raw(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(
        "event_id", "ts", "user_id", "event_type", "value")
    day = F.dayofmonth("ts")
    return [e.where(day <= 10), e.where((day > 10) & (day <= 20)), e.where(day > 20)]


def replay(spark, sf, job, mode="append", twice=False, close=False):
    """Land each part as four files with its rows spread over them, then let the job catch up,
    one file per micro-batch; returns the folder with its batches. ``close`` lands a
    heartbeat at last, which moves the watermark past the newest event."""
    landing, out, mark = (scratch_path(spark, x) for x in ("landing", "stream", "mark"))
    todo = [(stack(part, part) if twice else part).repartition(4, "event_id") for part in parts(spark, sf)]
    if close:
        newest = F.max("ts") + F.expr(f"interval {DELAY}") + F.expr("interval 1 second")
        todo.append(stack(*parts(spark, sf)).agg(newest.alias("ts")).select(
            F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("user_id"), F.lit(BEAT).alias("event_type"), F.lit(None).cast("double").alias("value")))
    for part in todo:
        part.write.mode("append").parquet(landing)
        jobs.run_available(job(jobs.read_landed(spark, landing, SCHEMA, batch_files=1)), out, mark, mode)
    return out


def sessions(spark, sf):
    """The trading days of ``b_sessions``."""
    day = F.to_date("ts")
    open_day = (F.pmod(F.datediff(day, F.lit("2024-01-01").cast("date")), F.lit(7)) < 5) & ~F.dayofmonth(day).isin(5, 11, 12, 13, 14, 26)
    return raw(spark, sf, "events").where(open_day).select(day.alias("date")).distinct()


def purchases(e):
    return e.where("event_type = 'purchase'").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), "event_id", "ts", (F.col("value") - 50).alias("gap_pct"))


def with_beat(e):
    """Purchases, and the heartbeat under a symbol of its own."""
    return purchases(e.withColumn("event_type", F.when(F.col("event_type") == BEAT, "purchase").otherwise(F.col("event_type"))))


def errors(e):
    return e.where("event_type = 'error'").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("event_id").alias("accession"),
        F.col("ts").alias("filed"), "value", F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 3 == 0).alias("materiality"))


@book.add("t1_ingest_upsert", "user_id:i event_type event_id:i value:f", """
SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY 1, 2""")
def ingest(spark, sf):
    out = replay(spark, sf, lambda e: jobs.upserts(e.drop("ts"), ["user_id", "event_type"], "event_id"), "update", twice=True)
    return jobs.read_latest(spark, out, ["user_id", "event_type"])


@book.add("t2_latest_signal", "symbol event_id:i gap_pct:f known_from:d", """
SELECT symbol, event_id, gap_pct, d + CASE dayofweek(d) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS known_from
FROM (SELECT 'U' || user_id AS symbol, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) - 50 AS gap_pct,
             CAST(max(ts) AS DATE) AS d FROM events WHERE event_type = 'purchase' GROUP BY 1) x""")
def latest_signal(spark, sf):
    out = replay(spark, sf, lambda e: jobs.latest_signals(purchases(e), "symbol", "ts", "event_id", ["gap_pct"]), "update")
    return jobs.read_latest(spark, out, ["symbol"])


# trading sessions with weekends, single holidays and one closing of several days left out
VIEWS["b_sessions"] = View("""
SELECT DISTINCT CAST(ts AS DATE) AS date FROM events
WHERE isodow(CAST(ts AS DATE)) < 6 AND day(CAST(ts AS DATE)) NOT IN (5, 11, 12, 13, 14, 26)""")


@book.add("t2_session_signal", "symbol event_id:i gap_pct:f known_from:d", """
WITH latest AS (
  SELECT 'U' || user_id AS symbol, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) - 50 AS gap_pct, CAST(max(ts) AS DATE) AS d
  FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT symbol, event_id, gap_pct, CASE WHEN d >= (SELECT min(date) FROM b_sessions) THEN (SELECT min(date) FROM b_sessions s WHERE s.date >= d) END AS known_from
FROM latest""")
def session_signal(spark, sf):
    calendar = sessions(spark, sf)
    out = replay(spark, sf, lambda e: jobs.latest_signals(purchases(e), "symbol", "ts", "event_id", ["gap_pct"], calendar), "update")
    return jobs.read_latest(spark, out, ["symbol"])


@book.add("t3_invalidated_signals", "symbol event_id:i gap_pct:f", """
SELECT 'U' || user_id AS symbol, event_id, value - 50 AS gap_pct FROM events s WHERE event_type = 'purchase' AND EXISTS
 (SELECT 1 FROM events m WHERE m.event_type = 'error' AND m.user_id = s.user_id AND m.event_id % 5 <> 0 AND m.event_id % 3 = 0
  AND m.ts > s.ts AND m.ts <= s.ts + INTERVAL 2 DAY)""")
def invalidated(spark, sf):
    out = replay(spark, sf, lambda e: jobs.invalidated(
        purchases(e), errors(e).where("materiality"), "symbol", "ts", "filed", "2 days", DELAY))
    return jobs.read_log(spark, out)


@book.add("t4_expired_signals", "symbol event_id:i", """
SELECT symbol, event_id FROM (
 SELECT 'U' || user_id AS symbol, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt,
        (SELECT max(ts) FROM events) AS final FROM events WHERE event_type = 'purchase') x
WHERE coalesce(nxt > ts + INTERVAL 3 DAY, TRUE) AND ts + INTERVAL 3 DAY <= final""")
def expired(spark, sf):
    out = replay(spark, sf, lambda e: jobs.expired(with_beat(e), "symbol", "ts", "event_id", 3, DELAY), close=True)
    return jobs.read_log(spark, out).where(F.col("event_id") >= 0)


@book.add("t5_first_verdicts", "symbol accession:i materiality:b", """
SELECT 'U' || user_id AS symbol, event_id AS accession, event_id % 3 = 0 AS materiality FROM events
WHERE event_type = 'error' AND event_id % 5 <> 0""")
def first_verdicts(spark, sf):
    out = replay(spark, sf, lambda e: jobs.first_verdicts(errors(e), ["symbol", "accession"], "filed", "materiality", DELAY), twice=True)
    return jobs.read_log(spark, out)


VIEWS["b_log_gaps"] = View("""
SELECT 'U' || user_id AS symbol, event_id, CASE WHEN value > 5 THEN ln(value / 50) END AS gap,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'purchase'""")
VIEWS["b_churn"] = View("""
SELECT symbol, event_id, gap, rn, TRUE AS emitted, gap AS last FROM b_log_gaps WHERE rn = 1
UNION ALL
SELECT g.symbol, g.event_id, g.gap, g.rn, coalesce(abs(g.gap - c.last) > 0.5, TRUE) AS emitted,
       CASE WHEN coalesce(abs(g.gap - c.last) > 0.5, TRUE) THEN g.gap ELSE c.last END AS last
FROM b_churn c JOIN b_log_gaps g ON g.symbol = c.symbol AND g.rn = c.rn + 1""")


@book.add("t6_churn_filter", "symbol event_id:i gap:f",
          "SELECT symbol, event_id, gap FROM b_churn WHERE emitted")
def churn(spark, sf):
    def job(e):
        p = with_beat(e).select("symbol", "event_id", "ts", (F.col("gap_pct") + 50).alias("value"))
        p = p.select("symbol", "event_id", "ts", F.when(F.col("value") > 5, F.ln(F.col("value") / 50)).alias("gap"))
        return jobs.churn_filter(p, "symbol", "ts", "event_id", "gap", 0.5, DELAY)
    return jobs.read_log(spark, replay(spark, sf, job, close=True)).where(F.col("event_id") >= 0)


@book.add("t7_archive_latest", "snapshot_date:d event_type rows:i", """
SELECT CAST(ts AS DATE) AS snapshot_date, event_type, count(*) AS rows FROM events
WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1, 2""")
def archive_latest(spark, sf):
    landing, out, mark = (scratch_path(spark, x) for x in ("landing", "archive", "mark"))
    for part in parts(spark, sf):
        part.write.mode("append").parquet(landing)
        jobs.archive(jobs.read_landed(spark, landing, SCHEMA).withColumn("snapshot_date", F.to_date("ts")), out, mark)
    return src.latest_snapshot(spark, out).groupBy("snapshot_date", "event_type").agg(F.count(F.lit(1)).alias("rows"))


@book.add("t8_published_counts", "window_start:d n:i",
          "SELECT CAST(ts AS DATE) AS window_start, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def published_counts(spark, sf):
    out = replay(spark, sf, lambda e: jobs.published_counts(purchases(e), "ts", "1 day", DELAY), "update")
    return jobs.read_latest(spark, out, ["window_start"])


@book.add("t8_sliding_counts", "window_start:d n:i", """
SELECT CAST(ts AS DATE) - CAST(back AS INT) AS window_start, count(*) AS n FROM events, (SELECT unnest(range(3)) AS back) b
WHERE event_type = 'purchase' AND CAST(ts AS DATE) - CAST(back AS INT) + INTERVAL 3 DAY <= (SELECT max(ts) + INTERVAL 1 SECOND FROM events) GROUP BY 1""")
def sliding_counts(spark, sf):
    out = replay(spark, sf, lambda e: jobs.published_counts(with_beat(e), "ts", "3 days", DELAY, "1 day"), close=True)
    return jobs.read_log(spark, out).select("window_start", "n")


@book.add("t8_published_sessions", "symbol started:d n:i", """
WITH p AS (SELECT 'U' || user_id AS symbol, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events WHERE event_type = 'purchase'),
     r AS (SELECT symbol, ts, count_if(was IS NULL OR ts >= was + INTERVAL 1 DAY) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM p)
SELECT symbol, CAST(min(ts) AS DATE) AS started, count(*) AS n FROM r GROUP BY symbol, run
HAVING max(ts) + INTERVAL 1 DAY <= (SELECT max(ts) + INTERVAL 1 SECOND FROM events)""")
def published_sessions(spark, sf):
    out = replay(spark, sf, lambda e: jobs.published_sessions(with_beat(e), "symbol", "ts", "1 day", DELAY), close=True)
    return jobs.read_log(spark, out).select("symbol", "started", "n")
