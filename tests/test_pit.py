"""As-of joins, spans, events: literal rows and no-look-ahead checks."""
import datetime as dt
import random

from pyspark.sql import functions as F

from pitval.operators import asof, spans


def d(s):
    return dt.date.fromisoformat(s)


def filings(spark, rows):
    return spark.createDataFrame(rows, "symbol string, filed_date date")


def closes(spark, rows):
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def test_annual_fallback_takes_the_earlier_close(spark):
    f = filings(spark, [("A", d("2023-03-01"))])
    annual = closes(spark, [("A", d("2021-12-31"), 80.0), ("A", d("2022-12-31"), 100.0), ("A", d("2023-12-31"), 150.0)])
    none = closes(spark, [("B", d("2023-02-27"), 1.0)])
    row = asof.price_filings(f, none, annual, "symbol").first()
    assert (row.close, row.price_source) == (100.0, "annual_prior")


def test_daily_beats_annual_within_tolerance_only(spark):
    f = filings(spark, [("A", d("2023-03-01")), ("A", d("2023-03-20"))])
    daily = closes(spark, [("A", d("2023-02-24"), 90.0), ("A", d("2023-03-02"), 91.0)])
    annual = closes(spark, [("A", d("2022-12-31"), 100.0)])
    got = {r.filed_date: (r.close, r.price_source) for r in asof.price_filings(f, daily, annual, "symbol").collect()}
    assert got == {d("2023-03-01"): (90.0, "daily"), d("2023-03-20"): (100.0, "annual_prior")}


def test_same_day_strict_and_forward(spark):
    f = filings(spark, [("A", d("2023-03-01"))])
    p = closes(spark, [("A", d("2023-02-01"), 1.0), ("A", d("2023-03-01"), 2.0), ("A", d("2023-04-01"), 3.0)])
    pick = lambda **k: asof.asof_join(f, p, ["symbol"], "filed_date", "date", ["close"], **k).first().close
    assert pick() == 2.0
    assert pick(strict=True) == 1.0
    assert pick(direction="forward") == 2.0
    assert pick(direction="forward", strict=True) == 3.0


def test_chained_lookups_keep_rows_of_a_key_together(spark):
    # both inputs of each union are hash partitioned alike: a plan that once lost matches
    days = spark.range(400).select(F.concat(F.lit("k"), (F.col("id") % 5).cast("string")).alias("k"),
                                   F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                                   F.col("id").cast("double").alias("v"))
    series = days.groupBy("k", "date").agg(F.max("v").alias("v"))
    span = series.groupBy("k").agg(F.min("date").alias("a"), F.max("date").alias("z"))
    out = asof.asof_join(span, series.withColumnsRenamed({"date": "x", "v": "first"}), ["k"], "a", "x", ["first"], direction="forward")
    out = asof.asof_join(out, series.withColumnsRenamed({"date": "x", "v": "last"}), ["k"], "z", "x", ["last"])
    assert {r.k: (r.first, r.last) for r in out.collect()} == {f"k{i}": (float(i), float(395 + i)) for i in range(5)}


def test_future_rows_and_row_order_change_nothing(spark):
    rng = random.Random(1)
    base = d("2022-01-01")
    p = [("A" if rng.random() < 0.9 else "B", base + dt.timedelta(days=i), float(i)) for i in range(200)]
    f = [(s, base + dt.timedelta(days=rng.randrange(150))) for s in "AAAAAAAB" for _ in range(20)]
    run = lambda rows, ff: sorted(map(tuple, asof.asof_join(
        filings(spark, ff), closes(spark, rows), ["symbol"], "filed_date", "date", ["close"]).collect()), key=repr)
    first = run(p[:151], f)
    rng.shuffle(p)
    rng.shuffle(f)
    assert run(p, f) == first
    for s, day, close in first:
        known = [c for k, t, c in p if k == s and t <= day]
        assert close == (max(known) if known else None)


def test_event_window_is_open_then_closed(spark):
    s = spark.createDataFrame([("A", d("2024-01-10"), d("2024-01-20")), ("A", d("2024-01-05"), d("2024-01-10")),
                               ("A", d("2024-01-10"), d("2024-01-10")), ("B", d("2024-01-01"), d("2024-02-01"))], "k string, a date, z date")
    e = spark.createDataFrame([("A", d("2024-01-10"))] * 3, "k string, filed date")
    got = [(r.k, r.a, r.has_event) for r in asof.event_between(s, e, ["k"], "a", "z", "filed").collect()]
    assert sorted(got) == [("A", d("2024-01-05"), True), ("A", d("2024-01-10"), False), ("A", d("2024-01-10"), False),
                           ("B", d("2024-01-01"), False)]


def test_windows_share_their_ends(spark):
    anchors = spark.createDataFrame([("A", d("2024-01-01")), ("A", d("2024-02-01"))], "k string, at date")
    f = spark.createDataFrame([("A", d(x), i) for i, x in enumerate(["2023-12-31", "2024-01-01", "2024-02-01", "2024-02-02", "2024-03-02"])],
                              "k string, filed date, n int")
    out = asof.assign_windows(f, anchors, ["k"], "filed", "at", F.lit("2024-03-01").cast("date")).collect()
    assert {r.n: r.window_start for r in out} == {1: d("2024-01-01"), 2: d("2024-01-01"), 3: d("2024-02-01")}


EVENTS = [("GONE", "2001-01-01", "removed", 1), ("BACK", "2002-01-01", "added", 1), ("BACK", "2003-01-01", "removed", 2),
          ("BACK", "2004-01-01", "added", 3), ("TWICE", "2002-01-01", "added", 1), ("TWICE", "2005-01-01", "added", 2),
          ("KEPT", "2003-01-01", "removed", 1)]
CURRENT = [("BACK", "Back Inc", "2004-01-01"), ("KEPT", "Kept Inc", "2006-01-01"), ("OLD", "Old Inc", None)]


def universe(spark):
    e = spark.createDataFrame([(t, d(x), a, s) for t, x, a, s in EVENTS], "ticker string, date date, action string, seq int")
    c = spark.createDataFrame([(t, n, d(x) if x else None) for t, n, x in CURRENT], "ticker string, company_name string, date_added date")
    return spans.spans_from_events(e, c)


def test_spans_follow_the_log(spark):
    got = sorted(((r.ticker, str(r.start_date), str(r.end_date), r.is_current_member) for r in universe(spark).collect()))
    assert got == sorted([
        ("GONE", "None", "2001-01-01", False), ("BACK", "2002-01-01", "2003-01-01", True), ("BACK", "2004-01-01", "None", True),
        ("TWICE", "2002-01-01", "2005-01-01", False), ("TWICE", "2005-01-01", "None", False),
        ("KEPT", "None", "2003-01-01", True), ("KEPT", "2006-01-01", "None", True), ("OLD", "None", "None", True)])


def test_membership_bounds_and_unknown(spark):
    u = universe(spark)
    probe = spark.createDataFrame([("BACK", d("2003-01-01")), ("BACK", d("2002-01-01")), ("KEPT", d("2004-01-01")),
                                   ("OLD", d("1950-01-01")), ("NEW", d("2020-01-01"))], "ticker string, at date")
    got = {(r.ticker, str(r.at)): r.is_member for r in spans.with_membership(probe, u, "ticker", "at").collect()}
    assert got == {("BACK", "2003-01-01"): False, ("BACK", "2002-01-01"): True, ("KEPT", "2004-01-01"): False,
                   ("OLD", "1950-01-01"): True, ("NEW", "2020-01-01"): False}
    admitted = spans.with_membership(probe, u, "ticker", "at", unknown_is_member=True).where("ticker = 'NEW'").first()
    assert admitted.is_member is True
    assert {r.ticker for r in spans.members_at(u, "ticker", "2003-01-01").collect()} == {"TWICE", "OLD"}


def test_sector_is_undone_newest_first(spark):
    from pitval import dims
    rows = spark.createDataFrame([("V", "Services financiers", d("2020-01-01")), ("V", "Services financiers", d("2023-03-17")),
                                  ("REIT", "Immobilier", d("2016-09-15")), ("REIT", "Immobilier", d("2016-09-16")), ("X", None, d("2000-01-01"))],
                                 "symbol string, sector string, filed_date date")
    got = [r.sector_asof for r in spans.sector_at(rows, dims.RECLASSIFICATIONS).collect()]
    assert got == ["Technologie", "Services financiers", "Services financiers", "Immobilier", None]


def test_momentum_counts_in_the_direction_of_the_gap(spark):
    import datetime as dt
    from pitval.operators import signals as sg
    day, rows = dt.date(2024, 3, 1), [("CALL_DOWN", 40.0, -0.5), ("CALL_UP", 40.0, 0.5), ("PUT_DOWN", -40.0, -0.5), ("PUT_UP", -40.0, 0.5),
                                      ("ZERO", 0.0, -0.5), ("UNKNOWN", None, -0.5), ("NO_HISTORY", -40.0, None), ("HELD", -40.0, 0.5)]
    signals = spark.createDataFrame([(s, day, i, "FY", g) for i, (s, g, _) in enumerate(rows)],
                                    "symbol string, published_date date, event_id long, period_type string, gap_pct double")
    grid = spark.createDataFrame([(s, day) for s, *_ in rows], "symbol string, date date")
    spans = spark.createDataFrame([(s, None, None) for s, *_ in rows], "symbol string, start_date date, end_date date")
    material = spark.createDataFrame([], "symbol string, filed_date date")
    momentum = spark.createDataFrame([(s, day, m) for s, _, m in rows], "symbol string, date date, momentum double")
    held = grid.where("symbol = 'HELD'")

    def kept(**how):
        return {r.symbol for r in sg.eligible(grid, signals, spans, material, momentum, held, **how).collect()}
    assert kept() == {"CALL_UP", "PUT_UP", "NO_HISTORY", "HELD"}
    assert kept(oriented=True) == {"CALL_UP", "PUT_DOWN", "ZERO", "UNKNOWN", "NO_HISTORY", "HELD"}


def test_medians_of_cohorts_with_nulls_move_numbers_only(spark, monkeypatch):
    import random
    import statistics

    from pitval.operators import peers
    rng, seen = random.Random(5), []
    rows = [(a, b, dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 60)), i, f"S{i}", rng.choice([None, rng.random()]))
            for i, (a, b) in enumerate(rng.choices([("x", None), (None, "x"), ("x", "x"), (None, None)], k=240))]
    df = spark.createDataFrame(rows, "a string, b string, filed date, tie long, symbol string, m double")
    attach = peers._attach
    monkeypatch.setattr(peers, "_attach", lambda df, answers, *rest: seen.extend(answers.dtypes) or attach(df, answers, *rest))
    out = peers.visible_medians(df, ["a", "b"], ["m"], "filed", "tie", block_rows=32, class_rows=8).collect()
    assert {kind for _, kind in seen} <= {"bigint", "int", "double"}
    for r in out:
        values = [v for a, b, f, i, _, v in rows if (a, b) == (r.a, r.b) and (f, i) < (r.filed, r.tie) and v is not None]
        assert r.m_n_peers == len(values)
        assert r.m_median is None if len(values) < 5 else abs(r.m_median - statistics.median(values)) < 1e-12
