"""Point-in-time joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..session import stack
from ..operators import asof, ordering, panel, spans
from . import flagship
from .bindings import VIEWS, View, raw, view
from .registry import Book

book = Book()


@book.add("j1_asof_price", "symbol fiscal_year:i filed_date:d price_date:d close:f", """
SELECT symbol, fiscal_year, filed_date, CASE WHEN filed_date - price_date <= 10 THEN price_date END AS price_date,
       CASE WHEN filed_date - price_date <= 10 THEN daily_close END AS close FROM b_priced_raw""")
def asof_price(spark, sf):
    p = view(spark, sf, "b_prices").select(F.col("symbol").alias("price_symbol"), "date", "close")
    return asof.asof_join(view(spark, sf, "b_financials"), p, ["price_symbol"], "filed_date", "date", ["close"], 10,
                          matched="price_date")


@book.add("j2_asof_fallback", "symbol fiscal_year:i close:f price_source",
          "SELECT symbol, fiscal_year, close, price_source FROM b_priced")
def asof_fallback(spark, sf):
    return flagship.priced(spark, sf)


@book.add("j2_source_summary", "price_source rows:i share:f", """
SELECT coalesce(price_source, 'none') AS price_source, count(*) AS rows,
       count(*) / (SELECT count(*) FROM b_priced) AS share FROM b_priced GROUP BY 1""")
def source_summary(spark, sf):
    by = flagship.priced(spark, sf).groupBy(F.coalesce("price_source", F.lit("none")).alias("price_source")).agg(
        F.count(F.lit(1)).alias("rows"))
    return by.withColumn("share", F.col("rows") / by.agg(F.sum("rows")).scalar())


VIEWS["b_filings"] = View("""
SELECT source AS cik, doc_id AS accession, CASE doc_id % 5 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' WHEN 2 THEN '10-K/A'
       ELSE '8-K' END AS form, DATE '2023-01-01' + CAST(doc_id % 90 AS INT) AS filed
FROM {documents}""")


@book.add("j3_preferred_form", "cik filed:d form accession:i", """
SELECT r.cik, r.filed, f.form, f.accession
FROM (SELECT DISTINCT cik, filed FROM b_filings) r
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cik, filed
                ORDER BY CASE form WHEN '10-K' THEN 1 WHEN '10-K/A' THEN 2 ELSE 3 END, accession) AS rn
           FROM b_filings WHERE form IN ('10-K', '10-K/A', '10-Q')) f
  ON f.cik = r.cik AND f.filed = r.filed AND rn = 1""")
def preferred_form(spark, sf):
    f = view(spark, sf, "b_filings")
    return asof.preferred_on_day(f.select("cik", "filed").distinct(), f, ["cik"], "filed", ["10-K", "10-K/A", "10-Q"],
                                 ["accession"], "accession")


VIEWS["b_spans"] = View("""
SELECT * FROM (
 SELECT ticker, CASE WHEN action = 'added' THEN date END AS start_date,
        CASE WHEN action = 'added' THEN next_date ELSE date END AS end_date
 FROM (SELECT *, lead(date) OVER w AS next_date, lag(action) OVER w AS prev FROM b_member_events
       WINDOW w AS (PARTITION BY ticker ORDER BY date, seq)) e
 WHERE action = 'added' OR prev IS DISTINCT FROM 'added'
 UNION ALL
 SELECT c.ticker, c.date_added, NULL FROM b_current c
 LEFT JOIN (SELECT ticker, max_by(action, (date, seq)) AS last FROM b_member_events GROUP BY ticker) l USING (ticker)
 WHERE last IS DISTINCT FROM 'added') s""")
VIEWS["b_asof_grid"] = View("""
SELECT u.ticker, d.date FROM (SELECT DISTINCT concat('U', CAST(user_id AS VARCHAR(20))) AS ticker FROM {events}) AS u
CROSS JOIN (SELECT DISTINCT CAST(ts AS DATE) AS date FROM {events}) AS d""")


def grid(spark, sf):
    """Each user on each day between the first and the last of the data."""
    e = raw(spark, sf, "events")
    first, last = (e.agg(f(F.to_date("ts"))).scalar() for f in (F.min, F.max))
    users = e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker")).distinct()
    return users.select("ticker", F.explode(F.sequence(first, last)).alias("date"))


@book.add("w11_membership_spans", "ticker start_date:d end_date:d is_current_member:b", """
SELECT s.ticker, start_date, end_date, c.ticker IS NOT NULL AS is_current_member
FROM b_spans s LEFT JOIN b_current c USING (ticker)""")
def membership_spans(spark, sf):
    return spans.spans_from_events(view(spark, sf, "b_member_events"), view(spark, sf, "b_current"))


@book.add("j4_membership_asof", "ticker date:d is_member:b", """
SELECT g.ticker, g.date, bool_or(s.ticker IS NOT NULL) AS is_member FROM b_asof_grid g
LEFT JOIN b_spans s ON s.ticker = g.ticker AND (s.start_date IS NULL OR s.start_date <= g.date)
 AND (s.end_date IS NULL OR s.end_date > g.date) GROUP BY 1, 2""")
def membership_asof(spark, sf):
    return spans.with_membership(grid(spark, sf), membership_spans(spark, sf), "ticker", "date")


@book.add("j4_unknown_admitted", "symbol published_date:d event_id:i is_member:b", """
SELECT g.symbol, g.published_date, g.event_id, CASE WHEN g.symbol NOT IN (SELECT ticker FROM b_spans WHERE ticker LIKE '%1')
       THEN TRUE ELSE EXISTS (SELECT 1 FROM b_spans s WHERE s.ticker = g.symbol
            AND (s.start_date IS NULL OR s.start_date <= g.published_date)
            AND (s.end_date IS NULL OR s.end_date > g.published_date)) END AS is_member FROM b_signals g""")
def unknown_admitted(spark, sf):
    some = membership_spans(spark, sf).where("ticker like '%1'")
    return spans.with_membership(view(spark, sf, "b_signals"), some, "symbol", "published_date", "ticker",
                                 unknown_is_member=True)


@book.add("j4_members_at", "ticker", """
SELECT DISTINCT ticker FROM b_spans WHERE (start_date IS NULL OR start_date <= DATE '2024-01-15')
 AND (end_date IS NULL OR end_date > DATE '2024-01-15')""")
def members_at(spark, sf):
    return spans.members_at(membership_spans(spark, sf), "ticker", "2024-01-15")


@book.add("j5_event_between", "event_id:i symbol has_event:b", """
SELECT s.event_id, s.symbol, EXISTS (SELECT 1 FROM b_material m WHERE m.symbol = s.symbol
  AND coalesce(m.materiality, FALSE) AND m.filed_date > s.published_date
  AND m.filed_date <= s.published_date + 3) AS has_event FROM b_signals s""")
def event_between(spark, sf):
    s = view(spark, sf, "b_signals").withColumn("upto", F.date_add("published_date", 3))
    m = view(spark, sf, "b_material").where(F.coalesce("materiality", F.lit(False)))
    return asof.event_between(s, m, ["symbol"], "published_date", "upto", "filed_date")


@book.add("j6_search_windows", "symbol accession:i filed_date:d window_start:d window_end:d", """
SELECT m.symbol, accession, m.filed_date, window_start, window_end
FROM b_material m JOIN LATERAL (
  SELECT min(w.s) AS window_start, min(w.e) AS window_end
  FROM (SELECT symbol, published_date AS s, coalesce(lead(published_date) OVER (PARTITION BY symbol
               ORDER BY published_date), DATE '2024-01-28') AS e
        FROM (SELECT DISTINCT symbol, published_date FROM b_signals) d) w
  WHERE w.symbol = m.symbol AND m.filed_date >= w.s AND m.filed_date <= w.e) x ON x.window_start IS NOT NULL""")
def search_windows(spark, sf):
    return asof.assign_windows(view(spark, sf, "b_material"), view(spark, sf, "b_signals"), ["symbol"], "filed_date",
                               "published_date", F.lit("2024-01-28").cast("date"))


@book.add("j7_dimension_priority", "symbol fiscal_year:i sector", """
SELECT f.symbol, f.fiscal_year, coalesce(a.c_mktsegment, n.n_name) AS sector FROM b_financials f
LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) a ON a.c_custkey = f.custkey
LEFT JOIN customer c ON c.c_custkey = f.custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""")
def dimension_priority(spark, sf):
    c = raw(spark, sf, "customer")
    first = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("_a"))
    names = raw(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("_b"))
    second = c.join(names, "c_nationkey").select(F.col("c_custkey").alias("custkey"), "_b")
    f = view(spark, sf, "b_financials").drop("sector")
    return f.join(first, "custkey", "left").join(second, "custkey", "left").withColumn("sector", F.coalesce("_a", "_b"))


@book.add("j8_null_safe_period", "symbol period_type fiscal_year:i fiscal_quarter revenue:f2 other:f2", """
SELECT a.symbol, a.period_type, a.fiscal_year, a.fiscal_quarter, a.revenue, b.ebitda AS other
FROM b_financials a LEFT JOIN (SELECT * FROM b_financials WHERE custkey % 4 > 0) b
  ON a.symbol = b.symbol AND a.period_type = b.period_type AND a.fiscal_year = b.fiscal_year
 AND a.fiscal_quarter IS NOT DISTINCT FROM b.fiscal_quarter""")
def null_safe_period(spark, sf):
    f = view(spark, sf, "b_financials")
    keys = ["symbol", "period_type", "fiscal_year", "fiscal_quarter"]
    return ordering.null_safe_join(f, f.where("custkey % 4 > 0").select(*keys, F.col("ebitda").alias("other")), keys)


@book.add("j9_qualitative_gate", "symbol fiscal_year:i filed_date:d", """
SELECT symbol, fiscal_year, filed_date FROM b_financials f WHERE NOT EXISTS
 (SELECT 1 FROM b_quarters q WHERE q.symbol = f.symbol AND q.fiscal_year = f.year AND q.quarter = 1
  AND q.discrete > 400000)""")
def qualitative_gate(spark, sf):
    verdict = F.when(F.col("discrete") > 400000, "contradictoire").otherwise("coherent")
    v = view(spark, sf, "b_quarters").where("quarter = 1").select(
        "symbol", F.lit("FY").alias("period_type"), "fiscal_year", F.lit(None).cast("string").alias("fiscal_quarter"),
        verdict.alias("verdict"))
    f = view(spark, sf, "b_financials")
    return ordering.null_safe_join(f, v.where("verdict = 'contradictoire'").drop("verdict"),
                                   ["symbol", "period_type", "fiscal_year", "fiscal_quarter"], "leftanti")


@book.add("j10_semi_symbols", "symbol fiscal_year:i", """
SELECT symbol, fiscal_year FROM b_financials WHERE symbol IN
 (SELECT 'C' || c_custkey FROM customer WHERE c_acctbal > 5000)""")
def semi_symbols(spark, sf):
    rich = raw(spark, sf, "customer").where("c_acctbal > 5000").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"))
    return view(spark, sf, "b_financials").join(rich, "symbol", "left_semi")


TEST_MOVES = (("1996-01-01", {"C7": "OLD SEVEN"}, {"MACHINERY": "METALS"}),
              ("1997-07-01", {"C8": "OLD EIGHT"}, {"HOUSEHOLD": "MACHINERY"}),
              ("1999-03-01", {"C7": "HOUSEHOLD"}, {}))


@book.add("j15_sector_asof", "symbol fiscal_year:i sector sector_asof", """
SELECT symbol, fiscal_year, sector, CASE WHEN filed_date < DATE '1996-01-01' THEN
   CASE WHEN symbol = 'C7' THEN 'OLD SEVEN' WHEN s2 = 'MACHINERY' THEN 'METALS' ELSE s2 END ELSE s2 END AS sector_asof
FROM (SELECT *, CASE WHEN filed_date < DATE '1997-07-01' THEN CASE WHEN symbol = 'C8' THEN 'OLD EIGHT'
             WHEN s1 = 'HOUSEHOLD' THEN 'MACHINERY' ELSE s1 END ELSE s1 END AS s2
      FROM (SELECT *, CASE WHEN filed_date < DATE '1999-03-01' AND symbol = 'C7' THEN 'HOUSEHOLD' ELSE sector END AS s1
            FROM b_financials) a) b""")
def sector_asof(spark, sf):
    return spans.sector_at(view(spark, sf, "b_financials"), TEST_MOVES)


@book.add("j16_align_series", "run_id date:d benchmark:f", """
SELECT n.run_id, n.date, p.close AS benchmark
FROM (SELECT run_id, date, 'Brand#1' AS symbol FROM b_nav) n
ASOF LEFT JOIN (SELECT * FROM b_prices WHERE symbol = 'Brand#1') p ON n.symbol = p.symbol AND n.date >= p.date""")
def align_series(spark, sf):
    b = view(spark, sf, "b_prices").where("symbol = 'Brand#1'").select("symbol", "date", F.col("close").alias("benchmark"))
    cal = view(spark, sf, "b_nav").select("run_id", "date", F.lit("Brand#1").alias("symbol"))
    return asof.align(b, cal, ["symbol"], "date", ["benchmark"])


VIEWS["b_dense"] = View("""
SELECT s.symbol, d.date, d.pos, p.close AS raw_close, p.open,
       max(CASE WHEN p.close IS NOT NULL THEN d.pos END) OVER w AS last_pos,
       max(CASE WHEN p.close IS NOT NULL THEN d.date END) OVER w AS last_valid_date
FROM (SELECT DISTINCT symbol FROM b_prices) s
CROSS JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM b_prices) x) d
LEFT JOIN b_prices p ON p.symbol = s.symbol AND p.date = d.date
WINDOW w AS (PARTITION BY s.symbol ORDER BY d.date)""")
VIEWS["b_panel"] = View("""
SELECT a.symbol, a.date, a.pos, a.open, a.last_valid_date, a.raw_close,
       CASE WHEN a.pos - a.last_pos <= 10 THEN b.raw_close END AS close
FROM b_dense a LEFT JOIN b_dense b ON a.symbol = b.symbol AND a.last_pos = b.pos""")


def price_panel(spark, sf):
    return panel.dense(view(spark, sf, "b_prices"))


@book.add("j17_dense_panel", "symbol date:d pos:i close:f open:f",
          "SELECT symbol, date, pos, close, open FROM b_panel")
def dense_panel(spark, sf):
    return price_panel(spark, sf)


@book.add("j18_coverage_table", "symbol price_years:i first_year:i last_year:i last_close:f filings:i last_filing:i "
                                "contracts:i last_snapshot:d complete:b", """
SELECT b.symbol, coalesce(price_years, 0) AS price_years, first_year, last_year, last_close,
       coalesce(filings, 0) AS filings, last_filing, coalesce(contracts, 0) AS contracts, last_snapshot,
       coalesce(price_years, 0) > 0 AND coalesce(filings, 0) > 0 AND coalesce(contracts, 0) > 0 AS complete
FROM (SELECT DISTINCT p_brand AS symbol FROM part UNION SELECT 'Brand#99') b
LEFT JOIN (SELECT symbol, count(DISTINCT year) AS price_years, min(year) AS first_year, max(year) AS last_year,
                  max_by(close, year) AS last_close FROM b_prices_annual GROUP BY 1) p USING (symbol)
LEFT JOIN (SELECT price_symbol AS symbol, count(DISTINCT year) AS filings, max(year) AS last_filing
           FROM b_financials GROUP BY 1) f USING (symbol)
LEFT JOIN (SELECT symbol, count(*) AS contracts, max(snapshot_date) AS last_snapshot FROM b_chain GROUP BY 1) c
  USING (symbol)""")
def coverage_table(spark, sf):
    base = stack(raw(spark, sf, "part").select(F.col("p_brand").alias("symbol")),
                 spark.createDataFrame([("Brand#99",)], "symbol string")).distinct()
    p = view(spark, sf, "b_prices_annual").groupBy("symbol").agg(
        F.count_distinct("year").alias("price_years"), F.min("year").alias("first_year"),
        F.max("year").alias("last_year"), F.max_by("close", "year").alias("last_close"))
    f = view(spark, sf, "b_financials").groupBy(F.col("price_symbol").alias("symbol")).agg(
        F.count_distinct("year").alias("filings"), F.max("year").alias("last_filing"))
    c = view(spark, sf, "b_chain").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("contracts"), F.max("snapshot_date").alias("last_snapshot"))
    out = base.join(p, "symbol", "left").join(f, "symbol", "left").join(c, "symbol", "left")
    out = out.fillna(0, ["price_years", "filings", "contracts"])
    return out.withColumn("complete", (F.col("price_years") > 0) & (F.col("filings") > 0) & (F.col("contracts") > 0))


@book.add("j19_verdict_cache", "symbol accession:i filed_date:d materiality:b from_cache:b", """
SELECT m.symbol, m.accession, m.filed_date, c.materiality, c.accession IS NOT NULL AS from_cache
FROM b_material m LEFT JOIN (SELECT symbol, accession, materiality FROM b_material
                             WHERE accession % 2 = 0 AND materiality IS NOT NULL) c USING (symbol, accession)""")
def verdict_cache(spark, sf):
    m = view(spark, sf, "b_material")
    cache = m.where("accession % 2 = 0 and materiality is not null").select(
        "symbol", "accession", "materiality", F.lit(True).alias("from_cache"))
    return m.drop("materiality").join(cache, ["symbol", "accession"], "left").fillna(False, ["from_cache"])
