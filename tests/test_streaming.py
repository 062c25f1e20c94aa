"""Streams replayed in parts equal their batch twins."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitval.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def land(spark, tmp_path):
    """Write parts one after another and run the job after each."""
    def run(parts, schema, job, mode="append"):
        base = tmp_path / str(random.random())
        landing, out, mark = (str(base / x) for x in ("in", "out", "mark"))
        for part in parts:
            spark.createDataFrame(part, schema).repartition(min(4, len(part))).write.mode("append").parquet(landing)
            jobs.run_available(job(jobs.read_landed(spark, landing, schema, batch_files=1)), out, mark, mode)
        return out
    return run


SIGNALS = "symbol string, ts timestamp, event_id long, gap double"


def events(n=120, seed=1):
    rng = random.Random(seed)
    rows = [(f"S{rng.choice([0, 0, 0, 1, 2])}", T0 + dt.timedelta(hours=5 * i), i, rng.choice([None, rng.uniform(-1, 1)])) for i in range(n)]
    return rows


def test_latest_signal_ignores_late_older_rows(spark, land):
    rows = events()
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    out = land([shuffled[:40], shuffled[40:80], shuffled[80:]], SIGNALS,
               lambda s: jobs.latest_signals(s, "symbol", "ts", "event_id", ["gap"]), "update")
    got = {r.symbol: r.event_id for r in jobs.read_latest(spark, out, ["symbol"]).collect()}
    assert got == {s: max(r[2] for r in rows if r[0] == s) for s in {r[0] for r in rows}}


def test_compaction_keeps_the_latest(spark, land, tmp_path):
    out = land([events()[:60], events()[60:]], SIGNALS, lambda s: jobs.upserts(s, ["symbol"], "event_id"), "update")
    target = str(tmp_path / "compact")
    jobs.compact(spark, out, target, ["symbol"])
    assert sorted(r.event_id for r in spark.read.parquet(target).collect()) == sorted(
        r.event_id for r in jobs.read_latest(spark, out, ["symbol"]).collect())


def test_weekend_publication_rolls_forward(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in range(5, 10)], "d date")
    assert [r.n.day for r in days.select(jobs.next_session(F.col("d")).alias("n")).collect()] == [5, 8, 8, 8, 9]


def test_signals_roll_over_holidays_and_closings(spark, land):
    calendar = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (2, 3, 4, 9, 10, 15)], "date date")
    rows = [("A", dt.datetime(2024, 1, 3, 22), 1, 0.0), ("B", dt.datetime(2024, 1, 5, 1), 2, 0.0), ("C", dt.datetime(2024, 1, 11), 3, 0.0),
            ("D", dt.datetime(2024, 1, 15, 23), 4, 0.0), ("E", dt.datetime(2024, 1, 16), 5, 0.0), ("F", dt.datetime(2024, 1, 1), 6, 0.0), ("A", dt.datetime(2024, 1, 10), 7, 0.0)]
    out = land([rows[:3], rows[3:6], rows[6:]], SIGNALS, lambda s: jobs.latest_signals(s, "symbol", "ts", "event_id", ["gap"], calendar), "update")
    got = {r.symbol: r.known_from and r.known_from.day for r in jobs.read_latest(spark, out, ["symbol"]).collect()}
    assert got == {"A": 10, "B": 9, "C": 15, "D": 15, "E": None, "F": None}


def test_churn_measures_from_the_last_emitted(spark, land):
    rows = [("A", T0 + dt.timedelta(days=i), i, v) for i, v in enumerate([0.0, 0.1, 0.2, 0.31, 0.35, None, 0.36, 0.2])]
    beat = [("beat", T0 + dt.timedelta(days=40), -1, None)]
    out = land([rows[:3], rows[3:5], rows[5:], beat], SIGNALS, lambda s: jobs.churn_filter(s, "symbol", "ts", "event_id", "gap", 0.25, "10 days"))
    # drift adds up to event 3; an unknown value passes and leaves no reference, so the next passes too
    assert sorted(r.event_id for r in jobs.read_log(spark, out).collect()) == [0, 3, 5, 6]


def test_signals_expire_without_a_successor(spark, land):
    rows = [("A", T0, 1, 0.0), ("A", T0 + dt.timedelta(days=2), 2, 0.0), ("B", T0 + dt.timedelta(days=3), 3, 0.0),
            ("B", T0 + dt.timedelta(days=9), 4, 0.0), ("C", T0 + dt.timedelta(days=22), 5, 0.0)]
    out = land([rows[:2], rows[2:4], rows[4:]], SIGNALS, lambda s: jobs.expired(s, "symbol", "ts", "event_id", 3, "10 days"))
    assert sorted(r.event_id for r in jobs.read_log(spark, out).collect()) == [2, 3]


def test_keys_that_share_a_state_do_not_meet(spark, land):
    import random
    rng = random.Random(3)
    rows = [(k, T0 + dt.timedelta(hours=rng.randint(0, 400)), i, rng.choice([None, rng.random()]))
            for i, k in enumerate(rng.choices([None, "", *[f"K{n}" for n in range(40)]], k=400))]
    end = max(r[1] for r in rows)
    beat = [("beat", end + dt.timedelta(days=20, seconds=1), -1, None)]
    cut = [rows[:150], rows[150:300], rows[300:], beat]
    over, moved = set(), set()
    for k in {r[0] for r in rows}:
        mine = sorted((at, i, v) for key, at, i, v in rows if key == k)
        last = None
        for (at, i, v), after in zip(mine, [*mine[1:], None]):
            if (after is None or after[0] > at + dt.timedelta(days=1)) and at + dt.timedelta(days=1) <= end:
                over.add(i)
            if v is None or last is None or abs(v - last) > 0.4:
                moved.add(i)
                last = v
    out = land(cut, SIGNALS, lambda s: jobs.expired(s, "symbol", "ts", "event_id", 1, "20 days", groups=2))
    assert {r.event_id for r in jobs.read_log(spark, out).collect()} == over
    out = land(cut, SIGNALS, lambda s: jobs.churn_filter(s, "symbol", "ts", "event_id", "gap", 0.4, "20 days", groups=2))
    got = {r.event_id: (r.symbol, r.ts, r.gap) for r in jobs.read_log(spark, out).collect()}
    assert set(got) == moved and all(got[i] == (k, at, v) for k, at, i, v in rows if i in moved)


def test_dedupe_leaves_non_verdicts_for_a_retry(spark, land):
    schema = "symbol string, accession long, filed timestamp, materiality boolean"
    rows = [("A", 1, T0, True), ("A", 1, T0, True), ("A", 2, T0, None), ("A", 2, T0 + dt.timedelta(minutes=5), False)]
    out = land([rows[:3], rows[3:]], schema, lambda s: jobs.first_verdicts(s, ["symbol", "accession"], "filed", "materiality", "1 day"))
    assert sorted((r.accession, r.materiality) for r in jobs.read_log(spark, out).collect()) == [(1, True), (2, False)]


def test_interval_semi_join(spark, land):
    schema = "kind string, symbol string, ts timestamp, event_id long"
    hour = dt.timedelta(hours=1)
    rows = [("s", "A", T0, 1), ("e", "A", T0, 2), ("s", "B", T0, 3), ("e", "B", T0 + 10 * hour, 4), ("s", "C", T0, 5), ("e", "C", T0 + 60 * hour, 6),
            ("e", "B", T0 + 11 * hour, 7)]
    out = land([rows[:3], rows[3:]], schema, lambda x: jobs.invalidated(
        x.where("kind = 's'"), x.where("kind = 'e'").select("symbol", F.col("ts").alias("filed")), "symbol", "ts", "filed", "2 days", "3 days"))
    assert [r.event_id for r in jobs.read_log(spark, out).collect()] == [3]


def test_rows_later_than_the_delay_fail_the_job(spark, land):
    rows = [("A", T0 + dt.timedelta(days=30), 1, 0.0), ("A", T0 + dt.timedelta(days=31), 2, 0.0), ("A", T0, 3, 0.0)]
    with pytest.raises(RuntimeError, match="later than the delay"):
        land([rows[:1], rows[1:2], rows[2:]], SIGNALS, lambda s: jobs.published_counts(s, "ts", "1 day", "1 hour"), "update")


def test_a_restart_does_not_hide_late_rows(spark, tmp_path):
    """The late row stands in an early batch of a long catch-up, of which only the last reports are kept."""
    landing, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    days = [30, 31, 0, *range(32, 38)]
    for i, d in enumerate(days):
        spark.createDataFrame([("A", T0 + dt.timedelta(days=d), i, 0.0)], SIGNALS).coalesce(1).write.mode("append").parquet(landing)

    def run(**how):
        jobs.run_available(jobs.published_counts(jobs.read_landed(spark, landing, SIGNALS, batch_files=1), "ts", "1 day", "1 hour"), out, mark, "update", **how)

    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        with pytest.raises(RuntimeError, match="1 rows came later than the delay"):
            run()
        with pytest.raises(RuntimeError, match="1 rows of earlier batches"):
            run()
        assert [r.rows for r in jobs.late_rows(spark, out).collect()] == [1]
        run(accept_late=True)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    assert {r.window_start for r in jobs.read_latest(spark, out, ["window_start"]).collect()} == {T0 + dt.timedelta(days=d) for d in days if d}
    assert [r.rows for r in jobs.late_rows(spark, out).collect()] == [1]


def at(hours):
    return ("A", T0 + dt.timedelta(hours=hours), hours, 0.0)


def test_a_late_row_joins_two_runs_into_one_session(spark, land):
    out = land([[at(0)], [at(20)], [at(10)], [at(40)], [at(500)]], SIGNALS,
               lambda s: jobs.published_sessions(s, "symbol", "ts", "12 hours", "2 days"))
    got = sorted((r.started, r.ended, r.n) for r in jobs.read_log(spark, out).collect())
    # hours 0, 10 and 20 are one run; the run of hour 500 is still open
    assert got == [(at(0)[1], at(32)[1], 3), (at(40)[1], at(52)[1], 1)]


def test_overlapping_windows_come_out_once_when_they_have_closed(spark, land):
    out = land([[at(1)], [at(30)], [at(26)], [at(500)]], SIGNALS,
               lambda s: jobs.published_counts(s, "ts", "2 days", "2 days", "1 day"))
    got = sorted((r.window_start, r.n) for r in jobs.read_log(spark, out).collect())
    assert got == [(T0 - dt.timedelta(days=1), 1), (T0, 3), (T0 + dt.timedelta(days=1), 2)]
