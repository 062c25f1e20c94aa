"""Fact resolution, quarters and trailing-twelve-month rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.symbols import duration_days, fiscal_year
from ..operators import facts as fx, fundamentals as fund
from ..session import keep
from .bindings import VIEWS, View, view
from .registry import Book

book = Book()

VIEWS["b_fact_rows"] = View("""
SELECT entity, metric, priority, start_day, end_day, filed, val, form, fy, fp, seq, end_day - start_day AS days,
       CASE WHEN month(end_day) < 6 THEN year(end_day) - 1 ELSE year(end_day) END AS fiscal_year FROM b_facts""")


def fact_rows(spark, sf):
    f = view(spark, sf, "b_facts").withColumnsRenamed({"start_day": "start", "end_day": "end"})
    return f.withColumns({"is_flow": F.lit(True), "days": duration_days(F.col("start"), F.col("end")),
                          "fiscal_year": fiscal_year(F.col("end")), "cik": F.col("entity").cast("string")})


@book.add("g5_first_published", "entity:i metric fiscal_year:i val:f filed:d", """
SELECT entity, metric, fiscal_year, min_by(val, (priority, filed, seq)) AS val, min_by(filed, (priority, filed, seq)) AS filed
FROM b_fact_rows WHERE form = '10-K' AND days BETWEEN 330 AND 400 GROUP BY 1, 2, 3""")
def first_published(spark, sf):
    return fx.first_published(fx.annual_facts(fact_rows(spark, sf)), ["entity", "metric", "fiscal_year"])


@book.add("g6_restatement_wins", "entity:i fiscal_year:i val:f filed:d fits:b", """
SELECT entity, fiscal_year, max_by(val, (days BETWEEN 60 AND 100, filed, seq)) AS val,
       max_by(filed, (days BETWEEN 60 AND 100, filed, seq)) AS filed, bool_or(days BETWEEN 60 AND 100) AS fits
FROM b_fact_rows GROUP BY 1, 2""")
def restatement_wins(spark, sf):
    return fx.latest_published(fact_rows(spark, sf), ["entity", "fiscal_year"], dims.QUARTER_DAYS)


@book.add("g7_period_owner", "entity:i fiscal_year:i priority:i entries:i", """
SELECT entity, fiscal_year, priority, count(*) AS entries FROM b_fact_rows f
WHERE priority = (SELECT min(priority) FROM b_fact_rows g WHERE g.entity = f.entity AND g.fiscal_year = f.fiscal_year)
GROUP BY 1, 2, 3""")
def period_owner(spark, sf):
    owned = fx.owned_by_best_tag(fact_rows(spark, sf), ["entity", "fiscal_year"])
    return owned.groupBy("entity", "fiscal_year", "priority").agg(F.count(F.lit(1)).alias("entries"))


TAGS = {1: "revenue", 2: "ebit", 3: "net_income", 4: "cash", 5: "capex"}
CASE = "CASE priority " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in TAGS.items()) + " END"


@book.add("g8_wide_periods", "entity:i fiscal_year:i revenue:f ebit:f net_income:f cash:f capex:f filed_date:d", f"""
SELECT entity, fiscal_year, {', '.join(f"max(CASE WHEN m = '{m}' THEN val END) AS {m}" for m in TAGS.values())},
       max(filed) AS filed_date
FROM (SELECT entity, fiscal_year, {CASE} AS m, min_by(val, (filed, seq)) AS val, min_by(filed, (filed, seq)) AS filed
      FROM b_fact_rows WHERE form = '10-K' AND days BETWEEN 330 AND 400 GROUP BY 1, 2, 3) x GROUP BY 1, 2""")
def wide_periods(spark, sf):
    f = fx.annual_facts(fact_rows(spark, sf)).withColumn("metric", F.expr(CASE)).withColumn("priority", F.lit(0))
    values = fx.first_published(f, ["entity", "fiscal_year", "metric"])
    return fx.wide_periods(values, ["entity", "fiscal_year"], list(TAGS.values()))


@book.add("g9_cover_page_snap", "seq:i period_end:d fiscal_year:i", """
SELECT c.seq, e.end_day AS period_end, CASE WHEN month(e.end_day) < 6 THEN year(e.end_day) - 1 ELSE year(e.end_day) END AS fiscal_year
FROM (SELECT * FROM b_fact_rows WHERE priority = 5 AND form = '10-K') c
ASOF JOIN (SELECT DISTINCT entity, end_day FROM b_fact_rows WHERE priority < 5 AND form = '10-K'
           AND days BETWEEN 330 AND 400) e ON e.entity = c.entity AND c.filed >= e.end_day""")
def cover_page(spark, sf):
    f = fact_rows(spark, sf).withColumn("cover_page", F.col("priority") == 5)
    return fx.snap_cover_page(f.withColumn("end", F.when(F.col("cover_page"), F.col("filed")).otherwise(F.col("end"))))


VIEWS["b_ytd"] = View("""
SELECT custkey, symbol, fiscal_year, CASE quarter WHEN 4 THEN 'FY' ELSE concat('Q', CAST(quarter AS VARCHAR(20))) END AS fp,
       (custkey + quarter) % 3 = 0 AND quarter < 4 AS direct,
       CASE WHEN (custkey + quarter) % 3 = 0 AND quarter < 4 THEN discrete ELSE cumulative END AS val, filed_date AS filed,
       make_date(fiscal_year, CAST(3 * quarter AS INT), 28) AS end_day
FROM {b_quarters}""")
VIEWS["b_ytd_wide"] = View("""
SELECT custkey, fiscal_year, max(val) FILTER (fp = 'Q1') AS q1, max(val) FILTER (fp = 'Q2') AS c2, max(val) FILTER (fp = 'Q3') AS c3,
       max(val) FILTER (fp = 'FY') AS cy, bool_or(direct) FILTER (fp = 'Q2') AS d2, bool_or(direct) FILTER (fp = 'Q3') AS d3,
       max(filed) FILTER (fp = 'Q1') AS f1, max(filed) FILTER (fp = 'Q2') AS f2, max(filed) FILTER (fp = 'Q3') AS f3,
       max(filed) FILTER (fp = 'FY') AS fy FROM b_ytd GROUP BY 1, 2""")


@book.add("w9_discrete_quarters", "custkey:i fiscal_year:i fiscal_quarter val:f2 filed_date:d", """
SELECT custkey, fiscal_year, q AS fiscal_quarter, v AS val, f AS filed_date FROM (
 SELECT custkey, fiscal_year, unnest(['Q1', 'Q2', 'Q3', 'Q4']) AS q, unnest([q1, q2, q3, cy - q1 - q2 - q3]) AS v,
        unnest([f1, CASE WHEN d2 THEN f2 ELSE greatest(f1, f2) END, CASE WHEN d3 THEN f3 ELSE greatest(g2, f1, f3) END,
                greatest(f1, g2, CASE WHEN d3 THEN f3 ELSE greatest(g2, f1, f3) END, fy)]) AS f
 FROM (SELECT *, CASE WHEN d3 THEN c3 ELSE c3 - q1 - q2 END AS q3
       FROM (SELECT *, CASE WHEN d2 THEN c2 ELSE c2 - q1 END AS q2, CASE WHEN d2 THEN f2 ELSE greatest(f1, f2) END AS g2
             FROM b_ytd_wide) a) b) c WHERE v IS NOT NULL""")
def discrete_quarters(spark, sf):
    return fx.discrete_quarters(view(spark, sf, "b_ytd").withColumnRenamed("end_day", "end"), ["custkey"])


# raw facts of reports: four fiscal calendars (a third of the companies close on week ends), the figure of
# the period, the restated one of the year before, and an event after the period
QUARTER_END = "last_day(make_date(CAST(floor(({m}) / 12) AS INT), CAST(({m}) % 12 AS INT) + 1, 1))"
NOMINAL = "(fiscal_year + CASE WHEN custkey % 4 = 3 THEN 1 ELSE 0 END) * 12 + 11 - 3 * (custkey % 4)"
VIEWS["b_periods"] = View(f"""
SELECT *, CASE WHEN direct OR quarter = 1 THEN {QUARTER_END.format(m=NOMINAL + ' - 3 * (5 - quarter)')}
               ELSE {QUARTER_END.format(m=NOMINAL + ' - 12')} END + CAST(1 AS INT) AS start_day,
       {QUARTER_END.format(m=NOMINAL + ' - 3 * (4 - quarter)')} + CAST(CASE WHEN custkey % 3 = 0 THEN (fiscal_year * 5 + quarter) % 11 - 5 ELSE 0 END AS INT) AS end_on
FROM (SELECT custkey, symbol, fiscal_year, fp, direct, val, filed, CASE WHEN fp = 'FY' THEN 4 ELSE CAST(substr(fp, 2, 1) AS INT) END AS quarter FROM {{b_ytd}}) AS q""")
VIEWS["b_raw_facts"] = View("""
SELECT custkey, concat(custkey, '-', fiscal_year, '-', quarter) AS accn, fiscal_year AS fy, fp, start_day, end_on, filed, val FROM {b_periods}
UNION ALL
SELECT o.custkey, concat(n.custkey, '-', n.fiscal_year, '-', n.quarter) AS accn, n.fiscal_year AS fy, n.fp, o.start_day, o.end_on, n.filed, 2 * o.val AS val
FROM {b_periods} AS o JOIN {b_periods} AS n ON n.custkey = o.custkey AND n.quarter = o.quarter AND n.fiscal_year = o.fiscal_year + 1
UNION ALL
SELECT custkey, concat(custkey, '-', fiscal_year, '-', quarter) AS accn, fiscal_year AS fy, fp, end_on + CAST(1 AS INT) AS start_day,
       end_on + CAST(25 AS INT) AS end_on, filed, CAST(5 AS DOUBLE) AS val FROM {b_periods}""")
VIEWS["b_restated"] = View("""
SELECT y.custkey, y.fiscal_year, y.fp, y.direct OR y.fp = 'Q1' AS direct, CASE WHEN n.custkey IS NULL THEN y.val ELSE 2 * y.val END AS val, coalesce(n.filed, y.filed) AS filed
FROM b_ytd y LEFT JOIN b_ytd n ON n.custkey = y.custkey AND n.fp = y.fp AND n.fiscal_year = y.fiscal_year + 1""")
VIEWS["b_restated_wide"] = View(VIEWS["b_ytd_wide"].text.replace("b_ytd", "b_restated"))
DISCRETE_SQL = book.items["w9_discrete_quarters"].sql


@book.add("w9_quarterly_flows", "custkey:i fiscal_year:i fiscal_quarter val:f2 filed_date:d", DISCRETE_SQL.replace("b_ytd_wide", "b_restated_wide"))
def quarterly_flows(spark, sf):
    periods = keep(view(spark, sf, "b_periods"))  # read for each kind of fact, and for the calendars and the figures
    f = view(spark, sf, "b_raw_facts", {"b_periods": periods}).withColumnsRenamed({"start_day": "start", "end_on": "end"})
    f = f.withColumns({"cik": F.col("custkey").cast("string"), "metric": F.lit("revenue"), "priority": F.lit(0),
                       "form": F.when(F.col("fp") == "FY", "10-K").otherwise("10-Q")})
    return fx.quarterly_flows(f).withColumn("custkey", F.col("cik").cast("long"))


@book.add("w8_trailing_year", "symbol fiscal_year:i fiscal_quarter discrete:f2 filed_date:d ttm_quarters_used", """
SELECT symbol, fiscal_year, 'Q' || quarter AS fiscal_quarter, CASE WHEN k = 4 THEN total END AS discrete, filed AS filed_date,
       used AS ttm_quarters_used
FROM (SELECT *, sum(flow) OVER w AS total, count(flow) OVER w AS k, count(*) OVER w AS n, max(filed_date) OVER w AS filed,
             string_agg(fiscal_year || 'Q' || quarter, ', ') OVER w AS used
      FROM (SELECT *, CASE WHEN custkey % 9 = 0 AND quarter = 2 THEN NULL ELSE discrete END AS flow FROM b_quarters) q
      WINDOW w AS (PARTITION BY symbol ORDER BY fiscal_year, quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) x WHERE n = 4""")
def trailing_year(spark, sf):
    q = view(spark, sf, "b_quarters").select(
        "symbol", "fiscal_year", F.concat(F.lit("Q"), F.col("quarter").cast("string")).alias("fiscal_quarter"), "filed_date",
        F.make_date("fiscal_year", F.col("quarter") * 3, F.lit(28)).alias("period_end"),
        F.when(~((F.col("custkey") % 9 == 0) & (F.col("quarter") == 2)), F.col("discrete")).alias("discrete"))
    return fund.ttm_rows(q, ["discrete"])
