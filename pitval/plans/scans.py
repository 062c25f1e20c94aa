"""Scans, sinks, set operations, upserts and refresh plans."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import symbols as fn
from ..operators import ordering, spans, valuation
from ..schema import EQUITY_CURVE
from ..session import scratch_path, stack
from ..sources import documents as docs, tables as src
from .bindings import SCHEMAS, VIEWS, View, raw, view
from .registry import Book

book = Book()


@book.add("s1_column_scan", "o_orderkey:i o_custkey:i o_totalprice:f",
          "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1998-01-01'")
def column_scan(spark, sf):
    t = src.read_table(spark, f"{sf}/orders.parquet", SCHEMAS["orders"],
                       ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
    return t.where("o_orderdate >= timestamp_ntz '1998-01-01 00:00:00'")


VIEWS["b_universe"] = View("""
SELECT CASE WHEN c_custkey = 3 THEN 'BRK.B' ELSE concat('K', CAST(c_custkey - c_custkey % 2 AS VARCHAR(20)), '.',
       CAST(c_custkey % 2 AS VARCHAR(20))) END AS RIC,
       c_name AS Instrument_Name, CASE WHEN c_nationkey % 3 = 0 THEN CAST(NULL AS VARCHAR(10))
       WHEN c_nationkey % 3 = 1 THEN 'XNAS' ELSE 'XOTC' END AS Exchange
FROM {customer}""")


@book.add("s2_csv_universe", "symbol RIC Instrument_Name exchange", """
SELECT CASE WHEN RIC = 'BRK.B' THEN 'BRK B' ELSE split_part(RIC, '.', 1) END AS symbol, min(RIC) AS RIC,
       min_by(Instrument_Name, RIC) AS Instrument_Name,
       min_by(CASE WHEN Exchange = 'XNAS' THEN 'NASDAQ' ELSE 'SMART' END, RIC) AS exchange
FROM b_universe GROUP BY 1""")
def csv_universe(spark, sf):
    path = scratch_path(spark, "universe")
    src.write_result(view(spark, sf, "b_universe"), path, "csv")
    codes = spark.createDataFrame([("XNAS", "NASDAQ")], "exchange string, code string")
    return src.read_universe(spark, path, exchange_map=codes)


@book.add("s3_snapshot_archive", "symbol snapshot_date:d contracts:i quoted:i volume:i", """
SELECT symbol, snapshot_date, count(*) AS contracts,
       count(CASE WHEN year(snapshot_date) >= 1998 THEN bid END) AS quoted, sum(volume) AS volume
FROM b_chain GROUP BY symbol, snapshot_date""")
def snapshot_archive(spark, sf):
    chain = view(spark, sf, "b_chain")
    early, late = scratch_path(spark, "archive"), scratch_path(spark, "archive")
    src.write_table(chain.where("year(snapshot_date) < 1998").drop("bid", "ask"), early)
    src.write_table(chain.where("year(snapshot_date) >= 1998"), late)
    return src.read_archive(spark, [early, late]).groupBy("symbol", "snapshot_date").agg(
        F.count(F.lit(1)).alias("contracts"), F.count("bid").alias("quoted"), F.sum("volume").alias("volume"))


@book.add("s4_nested_facts", "cik namespace tag unit start:d end:d val:f filed:d form fy:i fp accn", """
SELECT CAST(entity AS VARCHAR) AS cik, CASE WHEN entity % 9 = 0 THEN 'dei' ELSE 'us-gaap' END AS namespace,
       'Tag' || priority AS tag, 'USD' AS unit, CASE WHEN entity % 4 = 0 THEN NULL ELSE start_day END AS start,
       end_day AS "end", val, filed, form, fy, fp, CAST(seq AS VARCHAR) AS accn FROM b_facts""")
def nested_facts(spark, sf):
    f = view(spark, sf, "b_facts")
    fact = F.struct(F.col("seq").cast("string").alias("accn"),
                    F.when(F.col("entity") % 4 != 0, F.col("start_day").cast("string")).alias("start"),
                    F.col("end_day").cast("string").alias("end"), F.col("filed").cast("string").alias("filed"),
                    "form", "fy", "fp", "val")
    body = F.struct(F.create_map(F.lit("USD"), F.array(fact)).alias("units"))
    ns = F.when(F.col("entity") % 9 == 0, "dei").otherwise("us-gaap")
    doc = F.to_json(F.struct(F.col("entity").cast("string").alias("cik"), F.create_map(
        ns, F.create_map(F.concat(F.lit("Tag"), F.col("priority").cast("string")), body)).alias("facts")))
    return docs.facts_from_json(f.select(doc.alias("json")))


VIEWS["b_index_rows"] = View("""
SELECT source AS cik, CAST(floor(doc_id / 40) AS BIGINT) AS page, doc_id, CAST(doc_id AS VARCHAR(20)) AS accession,
       CASE WHEN doc_id % 4 = 0 THEN '10-K' ELSE '8-K' END AS form,
       CAST(DATE '2020-01-01' + CAST(doc_id % 700 AS INT) AS VARCHAR(10)) AS filed
FROM {documents}""")


@book.add("s5_filing_index", "cik accession form filed:d", """
SELECT cik, accession, form, CAST(filed AS DATE) AS filed
FROM (SELECT *, row_number() OVER (PARTITION BY cik, page ORDER BY doc_id DESC) AS from_end FROM b_index_rows) r
WHERE from_end > 1""")
def filing_index(spark, sf):
    rows = view(spark, sf, "b_index_rows")
    # a page of the index holds at most 40 filings; its date list is one short
    page = rows.groupBy("cik", "page").agg(F.sort_array(F.collect_list(F.struct("doc_id", "accession", "form", "filed")))
                                           .alias("a"))
    block = F.to_json(F.struct(F.col("a.accession").alias("accession"), F.col("a.form").alias("form"),
                               F.slice("a.filed", 1, F.size("a") - 1).alias("filed")))
    blocks = page.select("cik", block.alias("json"))
    return docs.filings_from_index(stack(blocks, blocks))


@book.add("s6_log_last_write", "symbol filed_date:d accession:i value:f unreadable:i", """
SELECT a.*, (SELECT count(*) FROM b_material WHERE accession % 17 = 0) AS unreadable
FROM (SELECT symbol, filed_date, max(accession) AS accession, max_by(value, accession) AS value
      FROM b_material WHERE accession % 17 <> 0 GROUP BY symbol, filed_date) a""")
def log_last_write(spark, sf):
    m = view(spark, sf, "b_material").select("symbol", "filed_date", "accession", "value")
    line = F.to_json(F.struct("*"))
    torn = F.when(F.col("accession") % 17 == 0, F.substring(line, 1, 25)).otherwise(line)
    path = scratch_path(spark, "log")
    m.select(torn.alias("value")).write.text(path)
    good, bad = src.read_log(spark, path, "symbol string, filed_date date, accession long, value double",
                             ["symbol", "filed_date"], "accession")
    return good.withColumn("unreadable", bad.agg(F.count("_corrupt")).scalar())


@book.add("s7_page_lists", "page_id:i position:i href label", r"""
SELECT page_id, pos - 1 AS position, regexp_extract(item, 'href="([^"]*)"', 1) AS href,
       regexp_extract(item, '>([^<>]*)</a>', 1) AS label
FROM (SELECT page_id, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS items FROM pages) p) q""")
def page_lists(spark, sf):
    return docs.html_links(raw(spark, sf, "pages"))


VIEWS["b_table_pages"] = View("""
SELECT event_id AS page_id, concat('<p>x</p><table class="wikitable"><tr><th>Date</th><th>Added</th><th>Added</th></tr>',
       '<tr><th>Date</th><th>Ticker</th><th>Security</th></tr><tr><td>', CAST(CAST(ts AS DATE) AS VARCHAR(10)), '</td><td><a href="/u">U',
       CAST(user_id AS VARCHAR(20)), '</a></td><td> A &amp; B ', CAST(event_id AS VARCHAR(20)), '</td></tr></table>') AS html
FROM {events} WHERE event_type = 'signup'""")


@book.add("s7_page_tables", "page_id:i row_no:i header text", """
SELECT event_id AS page_id, 2 AS row_no, c.header, c.text FROM events,
LATERAL (SELECT 'Date' AS header, CAST(CAST(ts AS DATE) AS VARCHAR) AS text
         UNION ALL SELECT 'Added Ticker', 'U' || user_id UNION ALL SELECT 'Added Security', 'A & B ' || event_id) c
WHERE event_type = 'signup'""")
def page_tables(spark, sf):
    return docs.html_table(view(spark, sf, "b_table_pages"))


@book.add("s8_overwrite_sink", "symbol date:d close:f", "SELECT symbol, date, close FROM b_prices")
def overwrite_sink(spark, sf):
    path = scratch_path(spark, "prices")
    p = view(spark, sf, "b_prices")
    src.write_table(p.where("volume > 100"), path)
    src.write_table(p, path)
    return spark.read.parquet(path)


@book.add("s9_archive_latest", "symbol snapshot_date:d option_type contracts:i", """
SELECT symbol, snapshot_date, option_type, count(*) AS contracts FROM b_chain
WHERE snapshot_date = (SELECT max(snapshot_date) FROM b_chain) GROUP BY symbol, snapshot_date, option_type""")
def archive_latest(spark, sf):
    path = scratch_path(spark, "chains")
    chain = view(spark, sf, "b_chain")
    src.append_snapshot(chain.where("snapshot_date < date '1999-01-01'"), path)
    src.append_snapshot(chain.where("snapshot_date >= date '1999-01-01'"), path)
    return src.latest_snapshot(spark, path).groupBy("symbol", "snapshot_date", "option_type").agg(
        F.count(F.lit(1)).alias("contracts"))


@book.add("s10_csv_json_sinks", "run_id trades:i pnl:f again:i", """
SELECT run_id, count(*) AS trades, sum(pnl) AS pnl, count(*) AS again FROM b_trades GROUP BY run_id""")
def csv_json(spark, sf):
    t = view(spark, sf, "b_trades").groupBy("run_id").agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("pnl"))
    a, b = scratch_path(spark, "csv"), scratch_path(spark, "json")
    src.write_result(t, a, "csv")
    src.write_result(t, b, "json")
    left = spark.read.schema("run_id string, trades long, pnl double").option("header", True).csv(a)
    right = spark.read.schema("run_id string, trades long").json(b).withColumnRenamed("trades", "again")
    return left.join(right, "run_id")


@book.add("s11_report_tables", "table_name sector value:f", """
SELECT 'detail' AS table_name, sector, CAST(count(*) AS DOUBLE) AS value FROM b_financials GROUP BY sector
UNION ALL SELECT 'wide', sector, avg(revenue) FROM b_financials GROUP BY sector""")
def report_tables(spark, sf):
    f = view(spark, sf, "b_financials")
    prefix = scratch_path(spark, "report")
    src.write_report({"detail": f, "wide": f.groupBy("sector").agg(F.avg("revenue").alias("value"))}, prefix)
    detail = spark.read.parquet(f"{prefix}/detail").groupBy("sector").agg(F.count(F.lit(1)).cast("double").alias("value"))
    wide = spark.read.parquet(f"{prefix}/wide")
    return stack(detail.withColumn("table_name", F.lit("detail")), wide.withColumn("table_name", F.lit("wide")))


@book.add("s12_load_run", "run_id date:d nav:f2 cash:f2 invested_value:f2 num_positions:i missing_rows:i", """
SELECT run_id, date, nav, NULL AS cash, invested_value, num_positions, 0 AS missing_rows FROM b_nav
WHERE run_id = '1-URGENT'""")
def load_run(spark, sf):
    root = scratch_path(spark, "runs")
    view(spark, sf, "b_nav").write.partitionBy("run_id").parquet(f"{root}/equity")
    equity = src.load_run(spark, root, "equity", EQUITY_CURVE, "1-URGENT")
    absent = src.load_run(spark, root, "signals", EQUITY_CURVE)
    return equity.withColumn("missing_rows", absent.agg(F.count(F.lit(1))).scalar())


@book.add("s13_latest_run", "run_id date:d nav:f2",
          "SELECT run_id, date, nav FROM b_nav WHERE run_id = (SELECT max(run_id) FROM b_nav)")
def latest_run(spark, sf):
    return src.latest_run(view(spark, sf, "b_nav"))


@book.add("o1_sort_nulls_first", "symbol fiscal_year:i ebitda:f position:i", """
SELECT symbol, fiscal_year, ebitda, row_number() OVER (ORDER BY ebitda NULLS FIRST, symbol DESC, fiscal_year) AS position
FROM b_financials""")
def sort_nulls(spark, sf):
    f = view(spark, sf, "b_financials").select("symbol", "fiscal_year", "ebitda")
    return ordering.ranked(f, [], [F.col("ebitda").asc_nulls_first(), F.col("symbol").desc(), F.col("fiscal_year").asc()],
                           "position")


@book.add("o3_union_by_name", "period_type rows:i quarters:i revenue:f2", """
SELECT period_type, count(*) AS rows, count(fiscal_quarter) AS quarters, sum(revenue) AS revenue
FROM (SELECT period_type, fiscal_quarter, revenue FROM b_financials
      UNION ALL SELECT 'TTM', 'Q' || quarter, cumulative FROM b_quarters) u GROUP BY period_type""")
def union_by_name(spark, sf):
    q = view(spark, sf, "b_quarters").select("symbol", "fiscal_year", F.lit("TTM").alias("period_type"), F.concat(
        F.lit("Q"), F.col("quarter").cast("string")).alias("fiscal_quarter"), F.col("cumulative").alias("revenue"))
    return stack(view(spark, sf, "b_financials"), q).groupBy("period_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count("fiscal_quarter").alias("quarters"), F.sum("revenue").alias("revenue"))


@book.add("o4_key_sets", "kind keys:i", """
SELECT 'both' AS kind, count(*) AS keys FROM (SELECT user_id FROM events WHERE event_type = 'error'
                              INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 400) a
UNION ALL SELECT 'only_error', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'error'
                              EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 400) b
UNION ALL SELECT 'any', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'error'
                              UNION SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 400) c""")
def key_sets(spark, sf):
    e = raw(spark, sf, "events")
    a = e.where("event_type = 'error'").select("user_id").distinct()
    b = e.where("event_type = 'purchase' and value > 400").select("user_id").distinct()
    parts = {"both": a.intersect(b), "only_error": a.join(b, "user_id", "left_anti"), "any": stack(a, b).distinct()}
    return stack(*[d.agg(F.count(F.lit(1)).alias("keys")).withColumn("kind", F.lit(k)) for k, d in parts.items()])


@book.add("o5_full_universe", "ric instrument_name country currency exchange", """
SELECT ticker AS ric, coalesce(c.company_name, t.ticker) AS instrument_name, 'United States' AS country,
       'USD' AS currency, 'SMART' AS exchange
FROM (SELECT ticker FROM b_member_events UNION SELECT ticker FROM b_current) t LEFT JOIN b_current c USING (ticker)""")
def full_universe(spark, sf):
    return spans.full_universe(spans.spans_from_events(view(spark, sf, "b_member_events"), view(spark, sf, "b_current")))


@book.add("d1_upsert_prices", "symbol date:d close:f", """
SELECT symbol, date, CASE WHEN date >= DATE '1997-01-01' THEN close + 1 ELSE close END AS close FROM b_prices""")
def upsert_prices(spark, sf):
    p = view(spark, sf, "b_prices").select("symbol", "date", "close")
    return src.upsert(p.where("date < date '1998-01-01'"),
                      p.where("date >= date '1997-01-01'").withColumn("close", F.col("close") + 1), ["symbol", "date"])


@book.add("w16_keep_last_write", "user_id:i event_type event_id:i value:f", """
SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY 1, 2""")
def keep_last_write(spark, sf):
    return ordering.keep_last(raw(spark, sf, "events").select("user_id", "event_type", "event_id", "value"),
                              ["user_id", "event_type"], "event_id")


@book.add("d2_pending", "symbol fiscal_year:i", """
SELECT symbol, fiscal_year FROM b_financials f WHERE NOT EXISTS
 (SELECT 1 FROM b_quarters q WHERE q.symbol = f.symbol AND q.fiscal_year = f.fiscal_year AND q.quarter = 4)""")
def still_pending(spark, sf):
    return src.pending(view(spark, sf, "b_financials").select("symbol", "fiscal_year"),
                       view(spark, sf, "b_quarters").where("quarter = 4"), ["symbol", "fiscal_year"])


@book.add("d3_refresh_plan", "symbol last_date:d fetch_from:d", """
SELECT c.symbol, last_date, CASE WHEN last_date IS NULL THEN DATE '1990-01-01'
       WHEN DATE '2001-12-31' - last_date > 300 THEN last_date END AS fetch_from
FROM (SELECT 'C' || c_custkey AS symbol FROM customer) c
LEFT JOIN (SELECT symbol, max(filed_date) AS last_date FROM b_financials GROUP BY symbol) l USING (symbol)""")
def refresh(spark, sf):
    universe = raw(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"))
    cached = view(spark, sf, "b_financials").select("symbol", F.col("filed_date").alias("date"))
    return src.refresh_plan(universe, cached, F.lit("1990-01-01").cast("date"), F.lit("2001-12-31").cast("date"), 300)


@book.add("d3_annual_refresh_plan", "symbol fetch_from_year:i", """
SELECT symbol, CASE WHEN last_year IS NULL THEN 1992 WHEN req IS NOT NULL AND 1992 < req THEN 1992
       WHEN last_year < 2000 THEN last_year + 1
       WHEN closing IS NULL OR DATE '2000-12-31' - closing > 60 THEN 2000 END AS fetch_from_year
FROM (SELECT 'C' || c_custkey AS symbol, CASE WHEN c_custkey % 20 = 0 THEN 1995 END AS req FROM customer) u
LEFT JOIN (SELECT symbol, max(year) AS last_year, max(CASE WHEN year = 2000 THEN filed_date END) AS closing
           FROM b_financials GROUP BY symbol) k USING (symbol)""")
def annual_refresh(spark, sf):
    u = raw(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"),
                                          F.when(F.col("c_custkey") % 20 == 0, 1995).alias("requested_from"))
    cached = view(spark, sf, "b_financials").select("symbol", "year", F.col("filed_date").alias("date"))
    return src.annual_refresh_plan(u, cached, 1992, 2000, F.lit("2000-12-31").cast("date"), 60)


@book.add("d4_add_benchmark", "symbol rows:i", """
SELECT symbol, count(*) AS rows FROM (SELECT DISTINCT symbol FROM b_prices
       UNION ALL SELECT * FROM (VALUES ('SPY')) v(symbol) WHERE symbol NOT IN (SELECT symbol FROM b_prices)) u GROUP BY 1""")
def add_benchmark(spark, sf):
    have = view(spark, sf, "b_prices").select("symbol").distinct()
    extra = spark.createDataFrame([("SPY",), ("Brand#1",)], "symbol string")
    return src.add_if_absent(have, extra, "symbol").groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


@book.add("f1_symbols", "ric symbol vendor", """
SELECT RIC AS ric, CASE WHEN RIC = 'BRK.B' THEN 'BRK B' ELSE split_part(RIC, '.', 1) END AS symbol,
       replace(replace(lower(RIC), ' ', '-'), '.', '-') || '.us' AS vendor FROM b_universe""")
def symbols(spark, sf):
    u = view(spark, sf, "b_universe")
    return u.select(F.col("RIC").alias("ric"), fn.canonical_symbol(F.col("RIC")).alias("symbol"),
                    fn.vendor_symbol(F.col("RIC")).alias("vendor"))


VIEWS["b_companies"] = View("""
SELECT c_name AS instrument_name, CASE c_custkey % 6 WHEN 0 THEN 'Financials' WHEN 1 THEN 'Energy' WHEN 2 THEN 'Utilities'
       WHEN 3 THEN 'Materials' WHEN 4 THEN 'Health Care' ELSE 'Unlisted' END AS gics_sector,
       CASE c_custkey % 4 WHEN 0 THEN 'Reinsurance' WHEN 1 THEN 'Regional Banks' WHEN 2 THEN 'Insurance Brokers'
       ELSE 'Other' END AS gics_sub_industry, c_custkey
FROM {customer}""")


@book.add("f7_sector_cascade", "instrument_name sector", """
SELECT instrument_name, CASE WHEN c_custkey % 50 = 1 THEN 'Chimie'
  WHEN gics_sector = 'Financials' THEN CASE gics_sub_industry WHEN 'Reinsurance' THEN 'Assurance'
       WHEN 'Regional Banks' THEN 'Banques' ELSE 'Services financiers' END
  WHEN c_custkey % 30 = 5 THEN 'Medias'
  ELSE CASE gics_sector WHEN 'Energy' THEN 'Pétrole et gaz' WHEN 'Utilities' THEN 'Services aux collectivités'
       WHEN 'Materials' THEN 'Matières premières' WHEN 'Health Care' THEN 'Santé' END END AS sector FROM b_companies""")
def sector_cascade(spark, sf):
    c = view(spark, sf, "b_companies")
    manual = c.where("c_custkey % 50 = 1").select(F.col("instrument_name").alias("name"), F.lit("Chimie").alias("sector"))
    cache = c.where("c_custkey % 30 = 5").select(F.col("instrument_name").alias("name"), F.lit("Medias").alias("sector"))
    return fn.resolve_sector(c, manual, cache)


@book.add("f8_period_key", "symbol period_type fiscal_year:i fiscal_quarter rows:i", """
SELECT symbol, period_type, fiscal_year, fiscal_quarter, count(*) AS rows FROM b_financials GROUP BY 1, 2, 3, 4""")
def period_keys(spark, sf):
    f = view(spark, sf, "b_financials")
    return f.groupBy(fn.period_key(f).alias("k")).agg(F.count(F.lit(1)).alias("rows")).select("k.*", "rows")


@book.add("p6_known_by", "symbol fiscal_year:i filed_date:d", """
SELECT symbol, fiscal_year, filed_date FROM b_financials WHERE filed_date <= DATE '1998-06-30'
 AND make_date(fiscal_year, 12, 31) <= DATE '1998-06-30'""")
def known_by(spark, sf):
    f = valuation.known_by(view(spark, sf, "b_financials"), "1998-06-30")
    return valuation.annual_known_by(f, "1998-06-30")
