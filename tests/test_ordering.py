"""Positions, quantiles, visible peers and capped weights against brute force."""
import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitval.operators import ordering as o, peers, signals as sg


def test_ranked_numbers_a_hot_key(spark):
    rows = [("hot", i % 50, i) for i in range(3000)] + [(None, 1, i) for i in range(20)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(7)
    got = {(r.k, r.id): r.pos for r in o.ranked(df, ["k"], [F.col("v").desc(), F.col("id").asc()]).collect()}
    for key in ("hot", None):
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [got[(key, r[2])] for r in ordered] == list(range(1, len(ordered) + 1))


def test_running_before_excludes_the_row(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(100)], "k string, i int, v double")
    got = {r.i: r.s for r in o.running_before(df, ["k"], [F.col("i")], "v", "s").collect()}
    assert all(got[i] == sum(range(i)) for i in range(100))


@pytest.mark.parametrize("sketch", [64, 4096])
def test_exact_quantiles(spark, sketch):
    rng = np.random.default_rng(3)
    data = {"mix": np.concatenate([rng.normal(0, 50, 400), [0.0, 0.0, -0.0, 1e-12, -1e-12, 1e9, -1e9]]), "one": np.array([3.25]),
            "same": np.full(50, 7.5), "near": 100 + rng.random(300) * 1e-6, None: rng.random(10)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("mix", None), ("mix", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"q05": 0.05, "median": 0.5, "q90": 0.9, "low": 0.0, "top": 1.0}
    out = {r.k: r for r in o.exact_quantiles(df, ["k"], "v", probs, count="n", sketch=sketch).collect()}
    assert set(out) == set(data)
    for k, vs in data.items():
        assert out[k].n == len(vs)
        for name, p in probs.items():
            assert out[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-15), (k, name)


def test_quantiles_of_a_hot_key_are_found_in_few_values(spark):
    """A third of all rows under one key; a small sketch, so that brackets are far from the ends."""
    rng = np.random.default_rng(4)
    hot, ties = rng.normal(0, 1, 60_000) * 10.0 ** rng.integers(-8, 8, 60_000), rng.integers(0, 40, 60_000).astype(float)
    data = {"hot": hot, "ties": ties, **{f"k{i}": rng.random(i % 50 + 1) for i in range(400)}, "ends": np.array([-1.7e308, 1.7e308, 0.0, np.inf])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(16)
    probs = {"q01": 0.01, "median": 0.5, "q75": 0.75, "q999": 0.999}
    asked = o.exact_quantiles(df, ["k"], "v", probs, count="n", sketch=256)
    out = {r.k: r for r in asked.collect()}
    assert set(out) == set(data)
    for k, vs in data.items():
        assert out[k].n == len(vs)
        for name, p in probs.items():
            if k != "ends":
                assert out[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-15), (k, name)
    assert out["ends"]["median"] == 0.85e308


def test_segmented_scan_of_a_hot_key(spark):
    rng = random.Random(9)
    rows = [("hot", i, rng.choice([None, None, rng.uniform(-5, 5)])) for i in range(4000)] + [(k, i, None if i < 3 else float(i)) for k in ("a", None) for i in range(6)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(5)
    out = o.segmented_scan(df, ["k"], [F.col("i")], {c: (c, F.col("v")) for c in ("last", "next", "max", "min", "sum")}).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"k", "i", "v", "last", "next", "max", "min", "sum"}
    for key in ("hot", "a", None):
        mine = sorted((r for r in out if r.k == key), key=lambda r: r.i)
        seen = []
        for n, r in enumerate(mine):
            seen += [r.v] if r.v is not None else []
            assert (r["last"], r["max"], r["min"]) == ((seen[-1], max(seen), min(seen)) if seen else (None,) * 3)
            assert r["sum"] == (pytest.approx(sum(seen)) if seen else None)
            assert r["next"] == next((x.v for x in mine[n:] if x.v is not None), None)


def test_keep_last_and_top_k(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, s int, v string")
    assert {(r.k, r.v) for r in o.keep_last(df, ["k"], "s").collect()} == {("a", "y"), ("b", "z")}
    assert [(r.k, r.s) for r in o.top_k(df, ["k"], [F.col("s").desc()], 1).orderBy("k").collect()] == [("a", 2), ("b", 1)]


# -- visible peers ------------------------------------------------------------------------

DAY = dt.date(2021, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, "sector string, symbol string, filed date, tie int, pe double")


def brute(rows, min_peers, spans=None):
    def member(symbol, at):
        mine = [s for s in spans if s[0] == symbol]
        return not mine or any((a is None or a <= at) and (z is None or z > at) for _, a, z in mine)
    out = {}
    for r in rows:
        cohort = sorted((x for x in rows if x[0] == r[0]), key=lambda x: (x[2] is None, x[2] or DAY, x[3]))
        if r[2] is None:
            seen = [x for x in cohort if x is not r]
        else:
            seen = cohort[:next(i for i, x in enumerate(cohort) if x is r)]
            if spans is not None:
                seen = [x for x in seen if member(x[1], r[2])]
        values = [x[4] for x in seen if x[4] is not None]
        out[(r[0], str(r[2]), r[3])] = (statistics.median(values) if len(values) >= min_peers else None, len(values))
    return out


def answer(df):
    return {(r.sector, str(r.filed), r.tie): (r.pe_median, r.pe_n_peers) for r in df.collect()}


def test_six_filers_see_only_those_before(spark):
    days = ["2021-02-01", "2021-02-10", "2021-02-20", "2021-03-01", "2021-03-15", "2021-04-01"]
    rows = [("S", f"C{i}", dt.date.fromisoformat(x), i, pe) for i, (x, pe) in enumerate(zip(days, [10.0, 11.0, 12.0, 13.0, 40.0, 45.0]))]
    got = answer(peers.visible_medians(frame(spark, rows), ["sector"], ["pe"], "filed", "tie"))
    assert [got[("S", x, i)][1] for i, x in enumerate(days)] == [0, 1, 2, 3, 4, 5]
    assert got[("S", "2021-02-01", 0)][0] is None and got[("S", "2021-04-01", 5)][0] == 12.0


@pytest.mark.parametrize("limits", [{}, {"block_rows": 37, "class_rows": 20}])
@pytest.mark.parametrize("with_spans", [False, True])
def test_visible_medians_match_brute_force(spark, limits, with_spans):
    rng = random.Random(5)
    rows = []
    for sector, n in (("big", 400), ("mid", 60), ("tiny", 3)):
        for i in range(n):
            filed = None if rng.random() < 0.03 else DAY + dt.timedelta(days=rng.randrange(40))
            pe = None if rng.random() < 0.1 else rng.choice([5.0, 5.0, 8.0, round(rng.uniform(1, 60), 2), rng.uniform(1, 60)])
            rows.append((sector, f"C{rng.randrange(n)}", filed, i, pe))
    spans = None
    spans_df = None
    if with_spans:
        spans = []
        for i in range(0, 400, 2):
            a = rng.randrange(-5, 30)
            spans.append((f"C{i}", DAY + dt.timedelta(days=a) if rng.random() < 0.7 else None, DAY + dt.timedelta(days=a + rng.randrange(1, 20))))
            if rng.random() < 0.5:
                spans.append((f"C{i}", DAY + dt.timedelta(days=a + 25), None))
        spans_df = spark.createDataFrame(spans, "symbol string, start_date date, end_date date")
    got = answer(peers.visible_medians(frame(spark, rows).repartition(5), ["sector"], ["pe"], "filed", "tie", spans=spans_df, **limits))
    want = brute(rows, 5, spans)
    assert got.keys() == want.keys()
    for k, (m, n) in want.items():
        assert got[k][1] == n and (got[k][0] is None) == (m is None) and (m is None or got[k][0] == pytest.approx(m, rel=1e-12)), k


def test_counts_carried_between_blocks_follow_the_rows(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(peers, "carried", lambda *a, real=peers.carried: tables.append(real(*a)) or tables[-1])
    rng = random.Random(9)
    sizes = []
    for n in (500, 1000):
        tables.clear()
        rows = [("S", f"C{i}", DAY + dt.timedelta(days=rng.randrange(300)), i, rng.uniform(1, 60)) for i in range(n)]
        peers.visible_medians(frame(spark, rows), ["sector"], ["pe"], "filed", "tie", block_rows=100, class_rows=8)
        sizes.append(sum(t.count() for t in tables))
    assert 0 < sizes[0] < 2 * 500 and sizes[1] < 2 ** 1.5 * 1.2 * sizes[0]


def test_adding_later_filers_changes_no_earlier_row(spark):
    rows = [("S", f"C{i}", DAY + dt.timedelta(days=i), i, 10.0 + i) for i in range(12)]
    short = answer(peers.visible_medians(frame(spark, rows[:8]), ["sector"], ["pe"], "filed", "tie"))
    full = answer(peers.visible_medians(frame(spark, rows), ["sector"], ["pe"], "filed", "tie"))
    assert all(full[k] == v for k, v in short.items())


# -- capped weights -----------------------------------------------------------------------


def iterate(c, cap):
    w = np.array(c) / sum(c)
    if cap * len(c) <= 1:
        return np.full(len(c), cap)
    for _ in range(500):
        over = w > cap + 1e-15
        if not over.any():
            break
        fixed = w >= cap - 1e-15
        w = np.where(fixed, cap, w)
        w[~fixed] *= (1 - cap * fixed.sum()) / w[~fixed].sum()
    return w


def test_capped_weights_match_redistribution(spark):
    rng = np.random.default_rng(7)
    groups = {f"g{n}-{s}": rng.pareto(1.0, n) * 10 + 0.01 for n in (1, 2, 3, 4, 5, 6, 8, 30) for s in range(3)}
    groups["equal"] = np.full(6, 2.0)
    rows = [(g, i, float(c)) for g, cs in groups.items() for i, c in enumerate(cs)]
    out = sg.capped_weights(spark.createDataFrame(rows, "g string, i int, c double"), ["g"], "c", "i", 20.0).collect()
    for g, cs in groups.items():
        w = np.array([r.weight for r in sorted((r for r in out if r.g == g), key=lambda r: r.i)])
        assert w == pytest.approx(iterate(cs, 0.2), abs=1e-9), g
        assert w.max() <= 0.2 + 1e-12 and w.sum() <= 1 + 1e-9


def test_sector_cap_and_baseline(spark):
    df = spark.createDataFrame([("d", "a", 0.2), ("d", "a", 0.2), ("d", None, 0.1)], "date string, sector string, weight double")
    got = sorted(r.weight for r in sg.cap_by_group(df, ["date"], "sector").collect())
    assert got == pytest.approx([0.1, 0.15, 0.15])
    rows = [("d", "x", float(v)) for v in (1, 2, 3, 4, 100)] + [("d", "y", 50.0)]
    base = {(r.sector, r.gap): r.baseline for r in sg.group_baseline(
        spark.createDataFrame(rows, "date string, sector string, gap double"), ["date"], "sector", "gap").collect()}
    assert base[("x", 1.0)] == 3.0 and base[("y", 50.0)] == statistics.median([1, 2, 3, 4, 100, 50])


def test_registry_and_settings():
    with pytest.raises(ValueError):
        sg.strategy("valuation_gap")(lambda s: s)
    assert {"valuation_gap", "sector_neutral", "option_gap"} <= set(sg.STRATEGIES)
    assert sg.settings({"a": None, "b": 3}, {"a": 2, "b": 2}, {"a": 1, "b": 1, "c": 1}) == {"a": 2, "b": 3, "c": 1}


def test_option_gap_bases_and_expected_value(spark):
    from pitval import dims
    rows = [("d", f"S{i}", 100.0, 100.0 * m, dt.date(2024, 1, 2)) for i, m in enumerate((1.5, 1.02, 0.6, 1.3))]
    s = spark.createDataFrame(rows, "date string, symbol string, close double, theoretical double, published_date date")
    flat = dims.inflation(spark, {2023: 0.0})
    for basis in ("log", "theoretical", "close"):
        out = {r.symbol: r for r in sg.option_gap(s, flat, basis=basis).collect()}
        assert set(out) == {"S0", "S2", "S3"} and out["S2"].direction == "PUT" and out["S0"].direction == "CALL"
    with pytest.raises(ValueError):
        sg.option_gap(s, flat, basis="median")
    market = s.select("date", "symbol", F.lit(0.3).alias("sigma"), F.lit(0.04).alias("r"), F.lit(0.0).alias("q"))
    got = {r.symbol: r for r in sg.option_expected_value(s, flat, market).collect()}
    assert set(got) <= {"S0", "S2", "S3"} and "S0" in got
    assert all(r.edge > 0 and r.strike_moneyness == pytest.approx(r.strike / 100) for r in got.values())


def test_positions_of_a_running_total_meet_no_second_shuffle(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), i, rng.choice([None, 1, 2, 3])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    out = o.running_before(df, ["k"], [F.col("i")], "v", "before")
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        earlier = [v for k, i, v in rows if k == r.k and i < r.i and v is not None]
        assert r.before == (None if r.v is None else sum(earlier))
