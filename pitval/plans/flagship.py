"""Price every filing as of its date, compare it with the peers already filed, rank the gap."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..session import cut
from ..operators import asof, peers, valuation as v
from .bindings import VIEWS, View, view
from .registry import Book

book = Book()

# SQL twins of the shared stages, for every oracle that builds on them
VIEWS["b_priced_raw"] = View("""
SELECT f.*, p.close AS daily_close, p.date AS price_date
FROM b_financials f ASOF LEFT JOIN b_prices p ON f.price_symbol = p.symbol AND f.filed_date >= p.date""")
VIEWS["b_priced"] = View("""
SELECT r.* EXCLUDE (daily_close, price_date),
       coalesce(CASE WHEN filed_date - price_date <= 10 THEN daily_close END, a.close) AS close,
       CASE WHEN filed_date - price_date <= 10 THEN 'daily' WHEN a.close IS NOT NULL THEN 'annual_prior' END AS price_source
FROM b_priced_raw r ASOF LEFT JOIN b_prices_annual a ON r.price_symbol = a.symbol AND r.filed_date >= a.date""")
VIEWS["b_multiples"] = View("""
SELECT *, EV / nullif(revenue, 0) AS "EV/Sales", EV / nullif(ebitda, 0) AS "EV/EBITDA",
       close / nullif(net_income / nullif(shares_outstanding, 0), 0) AS "P/E"
FROM (SELECT *, close * shares_outstanding AS market_cap,
             close * shares_outstanding + coalesce(net_debt, 0) AS EV FROM b_priced
      WHERE close IS NOT NULL AND shares_outstanding IS NOT NULL) m""")
VIEWS["b_clean"] = View("""
SELECT * REPLACE (CASE WHEN "EV/EBITDA" > 0 AND "EV/EBITDA" <= 50 THEN "EV/EBITDA" END AS "EV/EBITDA",
                  CASE WHEN "EV/Sales" > 0 AND "EV/Sales" <= 20 THEN "EV/Sales" END AS "EV/Sales",
                  CASE WHEN "P/E" > 0 AND "P/E" <= 60 THEN "P/E" END AS "P/E"),
       row_number() OVER (PARTITION BY sector, fiscal_year ORDER BY filed_date, tie_key) AS rn
FROM b_multiples""")
VIEWS["b_peer_medians"] = View("""
SELECT me.symbol, me.fiscal_year, count(p."EV/EBITDA") AS n1, count(p."EV/Sales") AS n2, count(p."P/E") AS n3,
       CASE WHEN count(p."EV/EBITDA") >= 5 THEN median(p."EV/EBITDA") END AS m1,
       CASE WHEN count(p."EV/Sales") >= 5 THEN median(p."EV/Sales") END AS m2,
       CASE WHEN count(p."P/E") >= 5 THEN median(p."P/E") END AS m3
FROM b_clean me LEFT JOIN b_clean p ON p.sector = me.sector AND p.fiscal_year = me.fiscal_year AND p.rn < me.rn
GROUP BY me.symbol, me.fiscal_year""")
VIEWS["b_implied"] = View("""
SELECT *,
       list_sort(list_filter([p1, p2, p3], lambda x: x IS NOT NULL)) AS sorted
FROM (SELECT m.*, d.n1, d.n2, d.n3, d.m1, d.m2, d.m3, p1, p2, p3,
             (p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT + (p3 IS NOT NULL)::INT AS n_used
      FROM b_multiples m JOIN b_peer_medians d ON m.symbol = d.symbol AND m.fiscal_year = d.fiscal_year,
      LATERAL (SELECT CASE WHEN m.ebitda > 0 AND shares_outstanding > 0
                           THEN (m1 * m.ebitda - net_debt) / shares_outstanding END AS p1,
                      CASE WHEN m.revenue > 0 AND shares_outstanding > 0
                           THEN (m2 * m.revenue - net_debt) / shares_outstanding END AS p2,
                      CASE WHEN m.net_income > 0 AND shares_outstanding > 0
                           THEN m3 * (m.net_income / shares_outstanding) END AS p3) x) y""")
VIEWS["b_valued"] = View("""
SELECT *, (sorted[(n_used + 1) // 2] + sorted[n_used // 2 + 1]) / 2 AS theoretical FROM b_implied""")
VIEWS["b_gaps"] = View("""
SELECT *, (theoretical - close) / close * 100 AS gap FROM b_valued WHERE theoretical IS NOT NULL""")


def priced(spark, sf):
    return asof.price_filings(view(spark, sf, "b_financials"), view(spark, sf, "b_prices"),
                              view(spark, sf, "b_prices_annual"), "price_symbol")


def multiples(spark, sf):
    return v.add_multiples(priced(spark, sf))


SHORT = {"EV/EBITDA": "ebitda_x", "EV/Sales": "sales_x", "P/E": "earnings_x"}


def with_peer_medians(rows, spans=None):
    """Plausible multiples under short names, with the median and number of their visible peers."""
    rows = rows.where("sector is not null").withColumns({a: v.plausible(m) for m, a in SHORT.items()})
    return peers.visible_medians(rows, v.COHORT, list(SHORT.values()), "filed_date", "tie_key", spans=spans)


def peer_medians(spark, sf, spans=None):
    return with_peer_medians(cut(multiples(spark, sf)), spans)


def valued(spark, sf):
    # priced once, read for the peers and for the rows
    med = with_peer_medians(cut(multiples(spark, sf)))
    named = med.withColumnsRenamed({f"{a}_{s}": f"{m}_{s}" for m, a in SHORT.items() for s in ("median", "n_peers")})
    return v.implied_prices(named.drop(*SHORT.values()), dims.sector_multiples(spark))


def gaps(spark, sf):
    t, c = F.col("valuation_multiples_per_share"), F.col("close")
    return valued(spark, sf).where(t.isNotNull()).withColumn("gap_pct", v.gap_pct(t, c))


@book.add("flagship_peer_gap", "symbol fiscal_year:i sector filed_date:d close:f valuation_multiples_per_share:f2 "
                               "n_peers:i n_multiples_used:i gap_pct:f2 direction candidate:b", """
SELECT symbol, fiscal_year, sector, filed_date, close, theoretical AS valuation_multiples_per_share,
       greatest(n1, n2, n3) AS n_peers, n_used AS n_multiples_used, gap AS gap_pct,
       CASE WHEN gap > 0 THEN 'CALL' ELSE 'PUT' END AS direction, abs(gap) >= 20 AS candidate FROM b_gaps""")
def flagship(spark, sf):
    gap = F.col("gap_pct")
    return gaps(spark, sf).withColumns({"direction": F.when(gap > 0, "CALL").otherwise("PUT"),
                                        "candidate": F.abs(gap) >= dims.ENTRY_THRESHOLD_PCT})


@book.add("j14_visible_peers", "symbol fiscal_year:i ebitda_x_median:f ebitda_x_n_peers:i sales_x_median:f "
                               "sales_x_n_peers:i earnings_x_median:f earnings_x_n_peers:i", """
SELECT symbol, fiscal_year, m1 AS ebitda_x_median, n1 AS ebitda_x_n_peers, m2 AS sales_x_median,
       n2 AS sales_x_n_peers, m3 AS earnings_x_median, n3 AS earnings_x_n_peers FROM b_peer_medians""")
def visible(spark, sf):
    return peer_medians(spark, sf)


VIEWS["b_peer_spans"] = View("""
SELECT concat('C', CAST(c_custkey AS VARCHAR(20))) AS symbol,
       CASE WHEN c_custkey % 4 = 0 THEN CAST(NULL AS DATE) ELSE make_date(CAST(1993 + c_custkey % 5 AS INT), 6, 1) END
       AS start_date,
       CASE WHEN c_custkey % 3 = 0 THEN CAST(NULL AS DATE) ELSE make_date(CAST(1998 + c_custkey % 4 AS INT), 3, 1) END
       AS end_date
FROM {customer} WHERE c_custkey % 10 <> 0""")


@book.add("j14_visible_member_peers", "symbol fiscal_year:i ebitda_x_median:f ebitda_x_n_peers:i sales_x_n_peers:i "
                                      "sales_x_median:f", """
SELECT me.symbol, me.fiscal_year, count(p."EV/EBITDA") AS ebitda_x_n_peers, count(p."EV/Sales") AS sales_x_n_peers,
       CASE WHEN count(p."EV/EBITDA") >= 5 THEN median(p."EV/EBITDA") END AS ebitda_x_median,
       CASE WHEN count(p."EV/Sales") >= 5 THEN median(p."EV/Sales") END AS sales_x_median
FROM b_clean me LEFT JOIN (SELECT c.*, s.symbol AS known, s.start_date, s.end_date
                           FROM b_clean c LEFT JOIN b_peer_spans s ON c.symbol = s.symbol) p
  ON p.sector = me.sector AND p.fiscal_year = me.fiscal_year AND p.rn < me.rn
 AND (p.known IS NULL OR ((p.start_date IS NULL OR p.start_date <= me.filed_date)
                          AND (p.end_date IS NULL OR p.end_date > me.filed_date)))
GROUP BY me.symbol, me.fiscal_year""")
def visible_members(spark, sf):
    return peer_medians(spark, sf, spans=view(spark, sf, "b_peer_spans"))
