"""Reported facts: documents to annual, quarterly and trailing tables; derived items."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pitval import dims
from pitval.operators import facts as fx, fundamentals as fund
from pitval.sources import documents as docs


def fact(end, val, filed, start=None, form="10-K", fy=2022, fp="FY", accn="a"):
    return {"accn": accn, "start": start, "end": end, "filed": filed, "form": form, "fy": fy, "fp": fp, "val": val}


DOC = {"cik": "1", "facts": {
    "us-gaap": {
        "Revenues": {"units": {"USD": [
            fact("2022-12-31", 100.0, "2023-02-01", "2022-01-01"), fact("2022-12-31", 101.0, "2024-02-01", "2022-01-01", accn="b"),
            fact("2021-12-31", 90.0, "2023-02-01", "2021-01-01"), fact("2022-12-31", 30.0, "2023-02-01", "2022-10-01"),
            fact("2023-05-28", 120.0, "2023-07-01", "2022-05-30"), fact("2022-12-31", 7.0, "2023-01-01", "2022-01-01", form="8-K")]}},
        "SalesRevenueNet": {"units": {"USD": [fact("2022-12-31", 55.0, "2023-01-05", "2022-01-01"),
                                              fact("2020-12-31", 80.0, "2021-02-01", "2020-01-01")]}},
        "Assets": {"units": {"USD": [fact("2022-12-31", 500.0, "2023-02-01")]}}},
    "dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": [fact("2023-01-20", 10.0, "2023-02-01")]}}}}}


def test_annual_table_takes_first_publication_of_the_best_tag(spark):
    long = docs.facts_from_json(spark.createDataFrame([(json.dumps(DOC),)], "json string"))
    assert long.count() == 10
    rows = {r.fiscal_year: r for r in fx.annual_table(long, dims.fact_tags(spark)).collect()}
    # an end in May belongs to the fiscal year before; it competes with the December year by publication
    assert rows[2022].revenue == 100.0 and rows[2022].filed_date == dt.date(2023, 2, 1)
    assert rows[2021].revenue == 90.0 and rows[2020].revenue == 80.0
    assert rows[2022].total_assets == 500.0 and rows[2022].shares_outstanding == 10.0


def test_parallel_arrays_stop_at_the_shortest(spark):
    block = {"accession": ["a", "b", "c"], "form": ["10-K", "8-K"], "filed": ["2024-01-01", "2024-01-02", "2024-01-03"]}
    df = spark.createDataFrame([("1", json.dumps(block)), ("1", json.dumps(block))], "cik string, json string")
    assert sorted((r.accession, r.form) for r in docs.filings_from_index(df).collect()) == [("a", "10-K"), ("b", "8-K")]


def test_quarters_from_cumulative_facts(spark):
    rows = [("1", "revenue", 0, "2022-01-01", "2022-03-31", 10.0, "2022-04-20", "10-Q", 2022, "Q1"),
            ("1", "revenue", 0, "2022-01-01", "2022-06-30", 25.0, "2022-07-20", "10-Q", 2022, "Q2"),
            ("1", "revenue", 0, "2022-01-01", "2022-09-30", 45.0, "2022-10-20", "10-Q", 2022, "Q3"),
            ("1", "revenue", 0, "2022-07-01", "2022-09-30", 19.0, "2022-10-20", "10-Q", 2022, "Q3"),
            ("1", "revenue", 0, "2022-01-01", "2022-12-31", 70.0, "2023-02-20", "10-K", 2022, "FY"),
            ("1", "revenue", 1, "2022-01-01", "2022-12-31", 99.0, "2023-02-21", "10-K", 2022, "FY"),
            ("1", "revenue", 0, "2023-01-01", "2023-06-30", 33.0, "2023-07-20", "10-Q", 2023, "Q2")]
    df = spark.createDataFrame([(*r, str(i)) for i, r in enumerate(rows)],
                               "cik string, metric string, priority int, start string, end string, val double, filed string, form string, "
                               "fy int, fp string, accn string")
    df = df.withColumns({c: F.to_date(c) for c in ("start", "end", "filed")})
    got = {(r.fiscal_year, r.fiscal_quarter): (r.val, str(r.filed_date)) for r in fx.quarterly_flows(df).collect()}
    assert got == {(2022, "Q1"): (10.0, "2022-04-20"), (2022, "Q2"): (15.0, "2022-07-20"), (2022, "Q3"): (19.0, "2022-10-20"),
                   (2022, "Q4"): (70.0 - 10 - 15 - 19, "2023-02-20")}


def quarters(spark, rows):
    return spark.createDataFrame([("A", y, q, dt.date(y, 3 * int(q[1]), 28), dt.date(y, 3 * int(q[1]), 28), v) for y, q, v in rows],
                                 "symbol string, fiscal_year int, fiscal_quarter string, period_end date, filed_date date, revenue double")


def test_trailing_year_needs_all_four(spark):
    q = quarters(spark, [(2021, "Q1", 1.0), (2021, "Q2", 2.0), (2021, "Q3", None), (2021, "Q4", 4.0), (2022, "Q1", 5.0),
                         (2022, "Q3", 6.0), (2022, "Q4", 7.0), (2023, "Q1", 8.0)])
    got = {(r.fiscal_year, r.fiscal_quarter): (r.revenue, r.ttm_quarters_used) for r in fund.ttm_rows(q, ["revenue"]).collect()}
    assert got[(2021, "Q4")] == (None, "2021Q1, 2021Q2, 2021Q3, 2021Q4")
    assert got[(2023, "Q1")][0] == 26.0 and len(got) == 5
    assert {(r.fiscal_year, r.fiscal_quarter) for r in fund.ttm_rows(q, ["revenue"], require_contiguous=True).collect()} == {
        (2021, "Q4"), (2022, "Q1")}


def test_ebit_cascade_and_zero_rule(spark):
    rows = [("A", 10.0, 8.0, 1.0, None), ("A", None, 8.0, 1.0, None), ("A", None, 8.0, None, None), ("B", None, 8.0, None, None),
            ("C", None, None, None, 5.0)]
    df = spark.createDataFrame(rows, "symbol string, ebit double, pretax_income double, interest_expense double, gross_profit double")
    df = df.withColumns({"operating_expenses": F.lit(2.0), "net_income": F.lit(4.0)})
    got = [(r.symbol, r.ebit, r.ebit_source) for r in fund.add_derived(df).collect()]
    assert sorted(got, key=repr) == sorted([
        ("A", 10.0, "operating_income"), ("A", 9.0, "pretax_plus_interest"), ("A", None, None), ("B", 8.0, "pretax_plus_interest"),
        ("C", 3.0, "gross_profit_less_opex")], key=repr)


def test_net_debt_needs_one_part(spark):
    df = spark.createDataFrame([("A", None, None, None), ("B", 5.0, None, 2.0)],
                               "symbol string, long_term_debt double, short_term_debt double, cash double")
    assert [r.net_debt for r in fund.add_derived(df).orderBy("symbol").collect()] == [None, 3.0]


def test_required_columns(spark):
    from pitval.schema import PRICES, compact_day, normalise, require
    with pytest.raises(ValueError):
        require(spark.range(1), ["symbol"])
    df = spark.createDataFrame([("A", "2024-01-01", float("nan")), ("B", "junk", 1.0)], "symbol string, date string, close double")
    got = normalise(df, PRICES).orderBy("symbol").collect()
    dates = spark.createDataFrame([("20240131",), ("2024",), (None,)], "t string").select(compact_day("t").alias("d"))
    assert [r.d for r in dates.collect()] == [dt.date(2024, 1, 31), None, None]
    assert got[0].close is None and got[0].volume is None and got[1].date is None and got[1].close == 1.0


def test_a_comparative_never_replaces_the_current_quarter(spark):
    kind = "cik string, metric string, priority int, accn string, form string, fy int, fp string, start date, end date, filed date, val double"
    day = dt.date
    rows = [("1", "revenue", 0, "r24", "10-Q", 2024, "Q1", day(2024, 1, 1), day(2024, 3, 31), day(2024, 5, 1), 110.0),
            ("1", "revenue", 0, "r24", "10-Q", 2024, "Q1", day(2023, 1, 1), day(2023, 3, 31), day(2024, 5, 1), 100.0),
            ("1", "revenue", 0, "r23", "10-Q", 2023, "Q1", day(2023, 1, 1), day(2023, 3, 31), day(2023, 5, 1), 99.0),
            ("1", "revenue", 0, "r24", "10-Q", 2024, "Q1", day(2023, 10, 1), day(2023, 12, 31), day(2024, 5, 1), 5.0)]
    for order in (rows, rows[::-1]):
        got = {(r.fiscal_year, r.fiscal_quarter): (r.val, str(r.period_end)) for r in fx.quarterly_flows(spark.createDataFrame(order, kind)).collect()}
        # the later filing restates the earlier year; an end that is not whole years back names no period
        assert got == {(2024, "Q1"): (110.0, "2024-03-31"), (2023, "Q1"): (100.0, "2023-03-31")}


def test_an_event_after_the_period_does_not_shift_a_report(spark):
    kind = "cik string, metric string, priority int, accn string, form string, fy int, fp string, start date, end date, filed date, val double"
    day = dt.date
    rows = [("1", "revenue", 0, "r24", "10-Q", 2024, "Q1", day(2024, 1, 1), day(2024, 3, 31), day(2024, 5, 1), 110.0),
            ("1", "revenue", 0, "r24", "10-Q", 2024, "Q1", day(2023, 1, 1), day(2023, 3, 31), day(2024, 5, 1), 100.0),
            ("1", "revenue", 0, "r24", "10-Q", 2024, "Q1", day(2024, 4, 1), day(2024, 4, 25), day(2024, 5, 1), 7.0),
            ("1", "revenue", 0, "r24", "10-Q", 2024, "Q1", None, day(2024, 4, 25), day(2024, 5, 1), 8.0)]
    got = {(r.fiscal_year, r.fiscal_quarter): r.val for r in fx.quarterly_flows(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(2024, "Q1"): 110.0, (2023, "Q1"): 100.0}


def test_years_of_whole_weeks_and_early_year_ends(spark):
    """A retailer's year of 52 or 53 weeks ends around 31 January and belongs to the year before."""
    kind = "cik string, metric string, priority int, accn string, form string, fy int, fp string, start date, end date, filed date, val double"
    day, ends = dt.date, [dt.date(2022, 1, 29), dt.date(2022, 4, 30), dt.date(2022, 7, 30), dt.date(2022, 10, 29), dt.date(2023, 1, 28),
                          dt.date(2023, 4, 29), dt.date(2023, 7, 29), dt.date(2023, 10, 28), dt.date(2024, 2, 3)]
    rows = []
    for i, end in enumerate(ends[1:], 1):
        q, year = (i - 1) % 4 + 1, 2022 + (i - 1) // 4
        begin = ends[4 * ((i - 1) // 4)] + dt.timedelta(days=1)
        rows.append(("1", "revenue", 0, f"r{i:02}", "10-K" if q == 4 else "10-Q", year, "FY" if q == 4 else f"Q{q}", begin, end, end + dt.timedelta(days=40), 100.0 * q + year))
    got = {(r.fiscal_year, r.fiscal_quarter): r.val for r in fx.quarterly_flows(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(y, f"Q{q}"): (100.0 + y if q == 1 else 100.0 if q < 4 else 400.0 + y - (300.0 + y)) for y in (2022, 2023) for q in (1, 2, 3, 4)}
    assert fx.fiscal_months(spark.createDataFrame(rows, kind)).first().fiscal_month == 1


def test_quarterly_flows_read_their_facts_once_for_the_calendar_and_once_for_the_figures(spark, tmp_path):
    kind = "cik string, metric string, priority int, accn string, form string, fy int, fp string, start date, end date, filed date, val double"
    day = dt.date
    quarter = ("10-Q", 2024, "Q1", day(2024, 1, 1), day(2024, 3, 31))
    rows = [("1", "revenue", 1, "r1", *quarter, day(2024, 4, 20), 10.0), ("1", "revenue", 1, "r2", *quarter, day(2024, 4, 25), 11.0),
            ("1", "revenue", 2, "r3", *quarter, day(2024, 6, 1), 99.0), ("1", "revenue", None, "r4", *quarter, day(2024, 7, 1), 98.0)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "facts"))
    out = fx.quarterly_flows(spark.read.schema(kind).parquet(str(tmp_path / "facts")))
    # the best tag owns the quarter, its latest filing tells the figure; a fact without a rank owns nothing
    assert [(r.fiscal_year, r.fiscal_quarter, r.val) for r in out.collect()] == [(2024, "Q1", 11.0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2
