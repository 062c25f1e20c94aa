"""Run metrics, sides, reconciliations and audits on small ledgers."""
import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitval import dims
from pitval.operators import ledger as lg

DAY = dt.date(2022, 1, 3)


def curve(spark, navs, run="r"):
    rows = [(run, DAY + dt.timedelta(days=i), float(v), float(v) / 2, i % 4) for i, v in enumerate(navs)]
    return spark.createDataFrame(rows, "run_id string, date date, nav double, invested_value double, num_positions int")


def flat_rates(spark, rate=0.0):
    return dims.rates(spark, {y: rate for y in range(2020, 2027)})


def test_metrics_against_pandas(spark):
    rng = np.random.default_rng(4)
    navs = 1e6 * np.cumprod(1 + rng.normal(0.0004, 0.01, 300))
    m = lg.run_metrics(curve(spark, navs), flat_rates(spark, 0.02)).first()
    s = pd.Series(navs)
    r = s.pct_change().dropna()
    x = r - 0.02 / 252
    years = 299 / 365.25
    assert m.total_return_pct == pytest.approx((navs[-1] / navs[0] - 1) * 100)
    assert m.cagr_pct == pytest.approx(((navs[-1] / navs[0]) ** (1 / years) - 1) * 100)
    assert m.annualized_volatility_pct == pytest.approx(r.std() * math.sqrt(252) * 100)
    assert m.sharpe_ratio == pytest.approx(x.mean() / x.std() * math.sqrt(252))
    assert m.sortino_ratio == pytest.approx(x.mean() / math.sqrt((np.minimum(x, 0) ** 2).mean()) * math.sqrt(252))
    assert m.skewness_daily_returns == pytest.approx(r.skew())
    assert m.kurtosis_daily_returns == pytest.approx(r.kurt())
    assert m.var_95_daily_pct == pytest.approx(r.quantile(0.05) * 100)
    assert m.cvar_95_daily_pct == pytest.approx(r[r <= r.quantile(0.05)].mean() * 100)
    assert m.max_drawdown_pct == pytest.approx((s / s.cummax() - 1).min() * 100)
    assert m.calmar_ratio == pytest.approx(m.cagr_pct / abs(m.max_drawdown_pct))


def test_drawdown_lasts_calendar_days(spark):
    m = lg.longest_drawdown(curve(spark, [100, 90, 95, 101, 100, 99, 98, 102])).first()
    assert m.max_drawdown_duration_days == 3 and m.max_drawdown_pct == pytest.approx(-10)
    assert lg.longest_drawdown(curve(spark, [1, 2, 3])).first().max_drawdown_duration_days == 0


def test_beta_of_a_leveraged_curve(spark):
    rng = np.random.default_rng(9)
    r = rng.normal(0, 0.01, 100)
    bench = 50 * np.cumprod(1 + r)
    rows = [(DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(bench)]
    b = spark.createDataFrame(rows, "date date, level double")
    for k in (1.0, 2.0):
        m = lg.benchmark_metrics(curve(spark, 1e6 * np.cumprod(1 + k * r)), b).first()
        assert m.beta == pytest.approx(k, rel=1e-9)
    assert m.alpha_pct is not None
    assert lg.benchmark_metrics(curve(spark, bench), b.limit(1)).count() == 0
    late = b.withColumn("date", F.date_add("date", 500))
    assert lg.benchmark_metrics(curve(spark, bench), late).count() == 0


def ledger(spark):
    nav = curve(spark, [1000.0] * 10)
    trades = spark.createDataFrame([("r", "A", "CALL", DAY + dt.timedelta(days=2), 30.0), ("r", "B", "PUT", DAY + dt.timedelta(days=4), -10.0),
                                    ("r", "C", "PUT", DAY + dt.timedelta(days=60), 99.0)],
                                   "run_id string, symbol string, option_type string, exit_date date, pnl double")
    pos = spark.createDataFrame([("r", DAY + dt.timedelta(days=d), s, k, 5.0, 50.0, 1.0) for d, s, k in ((5, "D", "CALL"), (5, "E", "PUT"), (6, "D", "CALL"))],
                                "run_id string, date date, symbol string, option_type string, unrealized_pnl double, market_value double, contracts double")
    return nav, trades, pos


def test_sides_add_up_to_the_whole(spark):
    nav, trades, pos = ledger(spark)
    c = lg.side_curves(nav, trades, pos)
    rows = {(r.side, (r.date - DAY).days): r for r in c.collect()}
    for i in range(10):
        parts = sum(rows[(s, i)].nav - 1000 for s in ("CALL", "PUT"))
        assert rows[("ALL", i)].nav - 1000 == pytest.approx(parts)
    assert rows[("ALL", 9)].nav == 1020 and rows[("CALL", 5)].nav == 1035 and rows[("PUT", 3)].nav == 1000
    own = nav.join(c.where("side = 'ALL'").select("date", F.col("nav").alias("n")), "date").select("run_id", "date", (F.col("n") + 7).alias("nav"))
    own = own.withColumn("total_cash_interest", F.lit(7.0))
    assert lg.reconciliation(own, c).first().max_abs_residual_dollar == 0.0


def test_quantities_reconcile(spark):
    _, _, pos = ledger(spark)
    ex = spark.createDataFrame([("r", "CALL", "buy", 3.0), ("r", "CALL", "sell", 2.0), ("r", "PUT", "buy", 4.0)],
                               "run_id string, option_type string, side string, contracts double")
    got = {r.option_type: r.gap for r in lg.quantity_reconciliation(ex, pos).collect()}
    assert got == {"CALL": 0.0, "PUT": 4.0}


def test_holes_reopen_positions(spark):
    d = [DAY + dt.timedelta(days=i) for i in range(5)]
    rows = [("r", d[0], "A", 5.0), ("r", d[1], "A", 8.0), ("r", d[2], "B", 1.0), ("r", d[3], "A", 4.0), ("r", d[4], "A", 4.0)]
    p = spark.createDataFrame(rows, "run_id string, date date, symbol string, contracts double")
    sig = spark.createDataFrame([("A", d[0], 12.0), ("A", d[2], -3.0)], "symbol string, date date, gap_pct double")
    got = sorted((r.symbol, (r.date - DAY).days, r.bought, r.reason) for r in lg.buys_from_positions(p, sig).collect())
    assert got == [("A", 0, 5.0, "signal_undervalued"), ("A", 1, 3.0, "added"), ("A", 3, 4.0, "signal_overvalued"), ("B", 2, 1.0, "new_position")]


def test_ranking_skips_failed_and_thin_runs(spark):
    rows = [("a", 1.0, 0.1, 50, None), ("b", 3.0, None, 5, None), ("c", 2.0, 0.3, 50, None), ("d", 9.0, 0.9, 50, "boom")]
    df = spark.createDataFrame(rows, "run_id string, sharpe double, train_sharpe double, num_trades int, error string")
    assert [r.run_id for r in lg.rank_runs(df, "sharpe", 10).collect()] == ["c", "a"]
    assert [r.run_id for r in lg.rank_runs(df.withColumn("train_sharpe", F.lit(None).cast("double")), "sharpe", 1).collect()] == ["b", "c", "a"]


def test_missing_run_parts_are_empty(spark, tmp_path):
    from pitval.schema import EQUITY_CURVE
    from pitval.sources import tables as src
    got = src.load_run(spark, str(tmp_path), "equity", EQUITY_CURVE)
    assert got.schema == EQUITY_CURVE and got.count() == 0


def test_csv_with_byte_order_mark(spark, tmp_path):
    from pitval.sources import tables as src
    path = tmp_path / "u.csv"
    path.write_bytes("﻿RIC,Instrument_Name,Exchange\nBRK.B,Berkshire,XNYS\nAAPL.O,Apple,XNAS\nAAPL.X,Apple again,\n".encode())
    got = {r.symbol: (r.Instrument_Name, r.exchange) for r in src.read_universe(spark, str(path)).collect()}
    assert got == {"BRK B": ("Berkshire", "XNYS"), "AAPL": ("Apple", "XNAS")}
    both = src.read_preferred_universe(spark, [str(tmp_path / "full.csv"), str(path)])
    assert both.count() == 2
    with pytest.raises(FileNotFoundError):
        src.read_preferred_universe(spark, [str(tmp_path / "full.csv")])
    (tmp_path / "bad.csv").write_text("A,B\n1,2\n")
    with pytest.raises(ValueError):
        src.read_universe(spark, str(tmp_path / "bad.csv"))


def test_headers_of_two_levels_flatten(spark):
    from pitval.sources import documents as docs
    html = ("<table><tr><th>Date</th><th>Added</th><th>Added</th></tr><tr><th>Date</th><th>Ticker</th><th>Name</th></tr>"
            "<tr><td>May 1</td><td><a href='x'>A&amp;B</a></td><td> One <b>Two</b></td></tr></table>")
    rows = docs.html_table(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert sorted((r.header, r.text) for r in rows) == [("Added Name", "One Two"), ("Added Ticker", "A&B"), ("Date", "May 1")]


def test_loose_json_and_sections(spark):
    from pitval.functions import text as tx
    rows = ['```json\n{"a": 1}\n```', 'sure: {"a": 2} ok', '{"a": 3', "none", '{"a": 4}', "[1]", None]
    df = spark.createDataFrame([(x,) for x in rows], "t string").select(tx.loose_json(F.col("t"), "a int").alias("v"))
    assert [r.v.a if r.v else None for r in df.collect()] == [1, 2, None, None, 4, None, None]
    body = "Item 1A. toc Item 7A nope " + "x" * 50 + " ITEM 1A – Risk factors here. Item 3. Legal. Item 37 "
    doc = spark.createDataFrame([(body, "10-K"), (body, "8-K"), ("nothing", "10-Q")], "text string, form string")
    out = tx.extract_sections(doc, "text", 60, "form").collect()
    assert out[0]["mode"] == "sections" and out[0].sections == 2
    assert out[0].excerpt == ("[Item 1A - Facteurs de risque]\nITEM 1A – Risk factors here.\n\n[Item 3 - Procedures judiciaires]\nItem 3. Legal. Item 37")[:60]
    assert (out[1]["mode"], out[1].excerpt) == ("debut_document", body[:60])
    assert (out[2]["mode"], out[2].excerpt) == ("debut_document", "nothing")


def test_positions_of_any_length_against_every_mark(spark):
    rng = random.Random(5)
    day = dt.date(2018, 1, 1)
    rows = [(rng.choice(["A", "B", None]), i, day + dt.timedelta(days=rng.randrange(900)), rng.randrange(1, 50)) for i in range(300)]
    rows = [(k, i, a, a + dt.timedelta(days=rng.choice([0, 1, 20, 400, 2500])), n) for k, i, a, n in rows] + [("C", 300, day, None, 7), ("C", 301, None, day, 9)]
    df = spark.createDataFrame(rows, "k string, i int, entry_date date, exit_date date, n long")
    end = dt.date(2018, 4, 28)
    got = {(r.k, r.date): (r.n, r.n_open) for r in lg.positions_on(df, ["k"], {"n": F.col("n")}, upto=F.lit(end)).collect()}
    want = {}
    for year in range(2018, 2030):
        for month in range(1, 13):
            mark = dt.date(year, month, 28)
            for k, _, a, z, n in rows:
                if a is not None and a <= mark < (z or end):
                    s, c = want.get((k, mark), (0, 0))
                    want[(k, mark)] = (s + n, c + 1)
    assert got == want


def test_positions_need_no_nested_loop(spark, sf):
    from pitval.plans import ledger_queries

    plan = ledger_queries.positions(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_trades_are_made_once_for_the_figures_by_exit_reason(spark, sf):
    from pitval.plans.bindings import view
    out = lg.pnl_by_exit_reason(view(spark, sf, "b_trades"))
    assert "lineitem" not in out._jdf.queryExecution().executedPlan().toString()
    rows = [("r", "CALL", "x", 10.0, 1.0, 5.0), ("r", "CALL", "x", -4.0, 2.0, 7.0), ("r", "CALL", "x", 1.0, 6.0, 9.0)]
    trades = spark.createDataFrame(rows, "run_id string, option_type string, exit_reason string, pnl double, return_pct double, holding_days double")
    got = lg.pnl_by_exit_reason(trades).collect()
    assert [(r.num_trades, r.pnl_dollar, r.avg_return_pct, r.median_return_pct, r.avg_holding_days) for r in got] == [(3, 7.0, 3.0, 2.0, 7.0)]
