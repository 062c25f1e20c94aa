"""Multiples, derived fundamentals, discounted cash flows, combination, coverage."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import symbols as fn
from ..operators import fundamentals as fund, ordering, valuation as v
from . import flagship
from .bindings import VIEWS, View, view
from .registry import Book

book = Book()


@book.add("p1_multiples", "symbol fiscal_year:i market_cap:f EV:f EV/Sales:f EV/EBITDA:f P/E:f",
          'SELECT symbol, fiscal_year, market_cap, EV, "EV/Sales", "EV/EBITDA", "P/E" FROM b_multiples')
def multiples(spark, sf):
    return flagship.multiples(spark, sf)


@book.add("p4_plausible_multiples", "symbol fiscal_year:i EV/Sales:f EV/EBITDA:f P/E:f",
          'SELECT symbol, fiscal_year, "EV/Sales", "EV/EBITDA", "P/E" FROM b_clean')
def plausible(spark, sf):
    return v.clean_multiples(flagship.multiples(spark, sf))


VIEWS["b_tagged"] = View("""
SELECT *, sum(CASE WHEN interest_expense IS NOT NULL THEN 1 ELSE 0 END) OVER w AS has_interest,
       sum(CASE WHEN da IS NOT NULL THEN 1 ELSE 0 END) OVER w AS has_da,
       sum(CASE WHEN capex IS NOT NULL THEN 1 ELSE 0 END) OVER w AS has_capex,
       sum(CASE WHEN income_tax_expense IS NOT NULL THEN 1 ELSE 0 END) OVER w AS has_tax,
       sum(CASE WHEN long_term_debt IS NOT NULL THEN 1 ELSE 0 END) OVER w AS has_ltd,
       sum(CASE WHEN short_term_debt IS NOT NULL THEN 1 ELSE 0 END) OVER w AS has_std
FROM b_reported WINDOW w AS (PARTITION BY symbol)""")
VIEWS["b_derived"] = View("""
SELECT *, coalesce(ebit0, pretax_income + zi, gross_profit - operating_expenses, revenue - costs_and_expenses) AS ebit,
       CASE WHEN ebit0 IS NOT NULL THEN 'operating_income' WHEN pretax_income + zi IS NOT NULL THEN 'pretax_plus_interest'
            WHEN gross_profit - operating_expenses IS NOT NULL THEN 'gross_profit_less_opex'
            WHEN revenue - costs_and_expenses IS NOT NULL THEN 'revenue_less_costs' END AS ebit_source,
       CASE WHEN long_term_debt IS NOT NULL OR short_term_debt IS NOT NULL OR cash IS NOT NULL
            THEN coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0) - coalesce(cash, 0) END AS net_debt,
       net_income + zda - zcapex AS fcf_simple, current_assets - current_liabilities AS working_capital,
       CASE WHEN zl + zs <> 0 THEN zi / (zl + zs + 1e-6) END AS cost_of_debt,
       ztax / nullif(net_income + ztax, 0) AS tax_rate
FROM (SELECT * EXCLUDE (ebit), ebit AS ebit0,
             CASE WHEN has_interest = 0 THEN 0 ELSE interest_expense END AS zi, CASE WHEN has_da = 0 THEN 0 ELSE da END AS zda,
             CASE WHEN has_capex = 0 THEN 0 ELSE capex END AS zcapex,
             CASE WHEN has_tax = 0 THEN 0 ELSE income_tax_expense END AS ztax,
             CASE WHEN has_ltd = 0 THEN 0 ELSE long_term_debt END AS zl,
             CASE WHEN has_std = 0 THEN 0 ELSE short_term_debt END AS zs FROM b_tagged) t""")


def derived(spark, sf):
    return fund.add_derived(view(spark, sf, "b_reported"))


@book.add("p2_derived_fundamentals", "symbol fiscal_year:i net_debt:f ebitda:f fcf:f working_capital:f cost_of_debt:f tax_rate:f", """
SELECT symbol, fiscal_year, net_debt, ebit + zda AS ebitda, fcf_simple AS fcf, working_capital, cost_of_debt, tax_rate
FROM b_derived""")
def derived_fundamentals(spark, sf):
    return derived(spark, sf)


@book.add("p3_ebit_cascade", "symbol fiscal_year:i ebit:f ebit_source",
          "SELECT symbol, fiscal_year, ebit, ebit_source FROM b_derived")
def ebit_cascade(spark, sf):
    return derived(spark, sf)


@book.add("w10_working_capital_change", "symbol fiscal_year:i working_capital_change:f", """
SELECT symbol, fiscal_year, working_capital - lag(working_capital) OVER (PARTITION BY symbol ORDER BY filed_date)
  AS working_capital_change FROM b_derived""")
def working_capital_change(spark, sf):
    return fund.working_capital_change(derived(spark, sf))


@book.add("p5_filed_date_fallback", "symbol fiscal_year:i filed_date:d filed_date_estimated:b", """
SELECT symbol, fiscal_year, CASE WHEN custkey % 5 = 0 THEN make_date(year + 1, 4, 1) ELSE filed_date END AS filed_date,
       custkey % 5 = 0 AS filed_date_estimated FROM b_financials""")
def filed_fallback(spark, sf):
    f = view(spark, sf, "b_financials")
    return v.fallback_filed_date(f.withColumn("filed_date", F.when(F.col("custkey") % 5 != 0, F.col("filed_date"))))


@book.add("p7_gaps", "symbol fiscal_year:i gap_pct:f2 gap_log:f gap_theoretical:f2", """
SELECT symbol, fiscal_year, gap AS gap_pct,
       CASE WHEN theoretical > 0 AND close > 0 THEN 100 * ln(theoretical / close) END AS gap_log,
       (theoretical - close) / nullif(theoretical, 0) * 100 AS gap_theoretical FROM b_gaps""")
def gap_measures(spark, sf):
    t, c = F.col("valuation_multiples_per_share"), F.col("close")
    return flagship.gaps(spark, sf).withColumns({"gap_log": v.log_gap(t, c), "gap_theoretical": v.gap_pct(t, c, t)})


@book.add("p8_log_points", "event_id:i pct:f points:f back:f", """
SELECT event_id, gap_pct AS pct, 100 * ln(1 + gap_pct / 100) AS points, gap_pct AS back FROM b_signals""")
def log_points(spark, sf):
    points = v.pct_to_log_points(F.col("gap_pct"))
    return view(spark, sf, "b_signals").select("event_id", F.col("gap_pct").alias("pct"), points.alias("points"),
                                               v.log_points_to_pct(points).alias("back"))


@book.add("p10_implied_prices", "symbol fiscal_year:i price_from_ev_ebitda:f2 price_from_ev_sales:f2 price_from_pe:f2 "
                                "valuation_multiples_per_share:f2 n_multiples_used:i n_peers:i", """
SELECT symbol, fiscal_year, p1 AS price_from_ev_ebitda, p2 AS price_from_ev_sales, p3 AS price_from_pe,
       theoretical AS valuation_multiples_per_share, n_used AS n_multiples_used, greatest(n1, n2, n3) AS n_peers
FROM b_valued""")
def implied(spark, sf):
    return flagship.valued(spark, sf)


TEST_RATES = {y: 0.01 + 0.002 * (y - 1990) for y in range(1990, 2005)}
TEST_SECTOR_DCF = {"BUILDING": (0.09, 0.04, 0.02), "MACHINERY": (0.10, 0.07, 0.03), "HOUSEHOLD": (0.065, 0.02, 0.015)}
VIEWS["d_rates"] = View("SELECT * FROM (VALUES " + ", ".join(
    f"({y}, CAST({r!r} AS DOUBLE))" for y, r in TEST_RATES.items()) + ") AS r(year, rate)")
VIEWS["d_sector_dcf"] = View("SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE), CAST({c!r} AS DOUBLE))"
    for s, (a, b, c) in TEST_SECTOR_DCF.items()) + ") AS d(sector, wacc, fcf_growth, terminal_growth)")
VIEWS["b_dcf_input"] = View("""
SELECT d.*, p.close, coalesce(s.fcf_growth, 0.05::DOUBLE) AS fcf_growth, coalesce(s.terminal_growth, 0.02::DOUBLE) AS terminal_growth,
       greatest(coalesce(r.rate, 0.04::DOUBLE) + (coalesce(s.wacc, 0.1::DOUBLE) - 0.04::DOUBLE),
                coalesce(s.terminal_growth, 0.02::DOUBLE) + 0.03::DOUBLE) AS wacc,
       working_capital - lag(working_capital) OVER (PARTITION BY d.symbol ORDER BY d.filed_date) AS wc_change
FROM b_derived d JOIN b_priced p ON p.symbol = d.symbol AND p.fiscal_year = d.fiscal_year
LEFT JOIN d_sector_dcf s ON s.sector = d.sector LEFT JOIN d_rates r ON r.year = year(d.filed_date) - 1""")
VIEWS["b_dcf"] = View("""
SELECT *, CASE WHEN reason IS NULL THEN (pv + fcf * pow(1 + fcf_growth, 5) * (1 + terminal_growth) / (wacc - terminal_growth)
             / pow(1 + wacc, 5) - net_debt) / shares_outstanding END AS dcf
FROM (SELECT *, CASE WHEN sector = 'FURNITURE' THEN 'sector_without_dcf' WHEN ebit IS NULL THEN 'ebit_missing'
             WHEN ebit <= 0 THEN 'ebit_not_positive' WHEN shares_outstanding <= 0 THEN 'shares_missing'
             WHEN fcf <= 0 THEN 'fcf_not_positive' WHEN wacc <= terminal_growth THEN 'wacc_not_above_growth'
             WHEN fcf IS NULL OR net_debt IS NULL THEN 'input_missing' END AS reason,
      fcf * ((1 + fcf_growth) / (1 + wacc) + pow((1 + fcf_growth) / (1 + wacc), 2) + pow((1 + fcf_growth) / (1 + wacc), 3)
           + pow((1 + fcf_growth) / (1 + wacc), 4) + pow((1 + fcf_growth) / (1 + wacc), 5)) AS pv
      FROM (SELECT *, ebit * (1 - CASE WHEN tax_rate >= 0 AND tax_rate < 1 THEN tax_rate ELSE 0.21 END)
                   + coalesce(da, 0) - capex - coalesce(wc_change, 0) AS fcf FROM b_dcf_input) a) b""")


def dcf_rows(spark, sf):
    rows = fund.working_capital_change(derived(spark, sf))
    close = flagship.priced(spark, sf).select("symbol", "fiscal_year", "close")
    rows = v.sector_assumptions(rows.drop("close").join(close, ["symbol", "fiscal_year"]),
                                dims.sector_dcf(spark, TEST_SECTOR_DCF), dims.rates(spark, TEST_RATES))
    return v.dcf_values(rows, excluded=["FURNITURE"])


@book.add("p12_dcf", "symbol fiscal_year:i fcf:f2 valuation_dcf_per_share:f2 gap_pct:f2 reason", """
SELECT symbol, fiscal_year, fcf, dcf AS valuation_dcf_per_share, (dcf - close) / nullif(close, 0) * 100 AS gap_pct, reason
FROM b_dcf""")
def dcf(spark, sf):
    return dcf_rows(spark, sf)


@book.add("p13_dcf_assumptions", "symbol fiscal_year:i wacc:f6 fcf_growth:f6 terminal_growth:f6",
          "SELECT symbol, fiscal_year, wacc, fcf_growth, terminal_growth FROM b_dcf_input")
def assumptions(spark, sf):
    rows = view(spark, sf, "b_reported")
    return v.sector_assumptions(rows, dims.sector_dcf(spark, TEST_SECTOR_DCF), dims.rates(spark, TEST_RATES))


@book.add("p14_rejections", "reason n:i share_pct:f", """
SELECT coalesce(reason, 'valued') AS reason, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM b_dcf) AS share_pct
FROM b_dcf GROUP BY 1""")
def rejections(spark, sf):
    return v.rejection_counts(dcf_rows(spark, sf))


VIEWS["b_combined"] = View("""
SELECT f.symbol, f.fiscal_year, f.sector, f.filed_date, f.close, f.period_type, m.theoretical AS m, d.dcf AS d,
       coalesce(m.theoretical, d.dcf) AS value, CASE WHEN m.theoretical IS NOT NULL THEN 'multiples'
       WHEN d.dcf IS NOT NULL THEN 'dcf_fallback' END AS source
FROM b_priced f LEFT JOIN b_valued m ON m.symbol = f.symbol AND m.fiscal_year = f.fiscal_year
LEFT JOIN b_dcf d ON d.symbol = f.symbol AND d.fiscal_year = f.fiscal_year""")


@book.add("p11_source_priority", "symbol fiscal_year:i valuation_theoretical_per_share:f2 source gap_pct:f2", """
SELECT symbol, fiscal_year, value AS valuation_theoretical_per_share, source, (value - close) / close * 100 AS gap_pct
FROM b_combined WHERE value IS NOT NULL AND close IS NOT NULL""")
def source_priority(spark, sf):
    d = dcf_rows(spark, sf).select("symbol", F.lit("FY").alias("period_type"), "fiscal_year",
                                   F.lit(None).cast("string").alias("fiscal_quarter"), "valuation_dcf_per_share")
    rows = ordering.null_safe_join(flagship.valued(spark, sf), d, ["symbol", "period_type", "fiscal_year", "fiscal_quarter"])
    return v.combine(rows)


@book.add("p22_signal_events", "symbol published_date:d fiscal_year:i sector close_at_filing:f valuation:f2 gap_pct:f2 "
                               "period_type", """
SELECT symbol, filed_date AS published_date, fiscal_year, sector, close AS close_at_filing, theoretical AS valuation,
       gap AS gap_pct, period_type FROM b_gaps""")
def signal_events(spark, sf):
    return v.signal_events(flagship.gaps(spark, sf), "valuation_multiples_per_share", "close_at_filing")


VIEWS["b_scored"] = View("""
SELECT symbol, fiscal_year, gap, abs(gap) AS abs_gap FROM b_gaps""")


@book.add("p15_thresholds", "symbol fiscal_year:i enter:b keep:b", """
SELECT symbol, fiscal_year, abs_gap >= 20 AS enter, abs_gap >= 14 AS keep FROM b_scored WHERE abs_gap >= 14""")
def thresholds(spark, sf):
    from ..operators import signals
    return signals.threshold_flags(flagship.gaps(spark, sf), "gap_pct").where("keep")


@book.add("p16_direction", "symbol fiscal_year:i direction conviction:f", """
SELECT symbol, fiscal_year, CASE WHEN gap > 0 THEN 'CALL' ELSE 'PUT' END AS direction, least(abs_gap, 100) AS conviction
FROM b_scored""")
def direction(spark, sf):
    from ..operators import signals
    return signals.directions(flagship.gaps(spark, sf), "gap_pct", 100.0)


@book.add("g1_sector_statistics", "sector multiple mean:f median:f min:f max:f std:f n:i", """
SELECT sector, multiple, avg(x) AS mean, median(x) AS median, min(x) AS min, max(x) AS max, stddev_samp(x) AS std, count(x) AS n
FROM (SELECT sector, unnest(['EV/EBITDA', 'EV/Sales', 'P/E']) AS multiple,
             unnest([CASE WHEN "EV/EBITDA" > 0 THEN "EV/EBITDA" END, CASE WHEN "EV/Sales" > 0 THEN "EV/Sales" END,
                     CASE WHEN "P/E" > 0 THEN "P/E" END]) AS x FROM b_multiples) u GROUP BY 1, 2""")
def sector_statistics(spark, sf):
    return v.group_statistics(flagship.multiples(spark, sf))


VIEWS["b_clean_long"] = View("""
SELECT sector, fiscal_year, unnest(['EV/EBITDA', 'EV/Sales', 'P/E']) AS multiple,
       unnest(["EV/EBITDA", "EV/Sales", "P/E"]) AS x FROM b_clean""")


@book.add("g2_cohort_medians", "sector fiscal_year:i multiple median:f n_peers:i", """
SELECT sector, fiscal_year, multiple, CASE WHEN count(x) >= 5 THEN median(x) END AS median, count(x) AS n_peers
FROM b_clean_long GROUP BY 1, 2, 3""")
def cohort_medians(spark, sf):
    return v.cohort_medians(flagship.multiples(spark, sf))


@book.add("g3_wide_summary", "sector EV/EBITDA_mean:f EV/EBITDA_median:f P/E_mean:f P/E_median:f EV/Sales_median:f", """
SELECT sector, avg("EV/EBITDA") FILTER ("EV/EBITDA" > 0) AS "EV/EBITDA_mean",
       median("EV/EBITDA") FILTER ("EV/EBITDA" > 0) AS "EV/EBITDA_median", avg("P/E") FILTER ("P/E" > 0) AS "P/E_mean",
       median("P/E") FILTER ("P/E" > 0) AS "P/E_median", median("EV/Sales") FILTER ("EV/Sales" > 0) AS "EV/Sales_median"
FROM b_multiples GROUP BY sector""")
def wide_summary(spark, sf):
    return v.wide_statistics(v.group_statistics(flagship.multiples(spark, sf)))


@book.add("g4_latest_period", "symbol fiscal_year:i filed_date:d revenue:f", """
SELECT symbol, max_by(fiscal_year, filed_date) AS fiscal_year, max(filed_date) AS filed_date,
       max_by(revenue, filed_date) AS revenue FROM b_financials GROUP BY symbol""")
def latest_period(spark, sf):
    f = view(spark, sf, "b_financials").select("symbol", "fiscal_year", "filed_date", "revenue")
    return f.groupBy("symbol").agg(F.max_by(F.struct("fiscal_year", "revenue"), "filed_date").alias("r"),
                                   F.max("filed_date").alias("filed_date")).select("symbol", "filed_date", "r.*")


@book.add("g10_counts_shares", "sector rows:i symbols:i share:f", """
SELECT sector, count(*) AS rows, count(DISTINCT symbol) AS symbols,
       count(*) / (SELECT count(*) FROM b_financials) AS share FROM b_financials GROUP BY sector""")
def counts_shares(spark, sf):
    # distinct symbols counted in two steps so that a big sector is spread by symbol
    f = view(spark, sf, "b_financials").groupBy("sector", "symbol").agg(F.count(F.lit(1)).alias("n"))
    by = f.groupBy("sector").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("symbols"))
    return by.withColumn("share", F.col("rows") / by.agg(F.sum("rows")).scalar())


@book.add("g11_fill_rates", "fiscal_year:i column_name rows:i filled:i fill_rate:f", """
SELECT fiscal_year, column_name, count(*) AS rows, count(x) AS filled, count(x) / count(*) AS fill_rate
FROM (SELECT fiscal_year, unnest(['ebit', 'da', 'capex']) AS column_name, unnest([ebit, da, capex]) AS x FROM b_reported) u
GROUP BY 1, 2""")
def fill_rates(spark, sf):
    return fund.fill_rates(view(spark, sf, "b_reported"), ["fiscal_year"], ["ebit", "da", "capex"])


@book.add("g11_usability", "coverage keys:i", """
SELECT CASE WHEN u = 0 THEN 'none' WHEN u < n THEN 'partial' ELSE 'all' END AS coverage, count(*) AS keys
FROM (SELECT symbol, count(CASE WHEN capex IS NOT NULL AND ebit > 0 THEN 1 END) AS u, count(*) AS n
      FROM b_reported GROUP BY symbol) s GROUP BY 1""")
def usability(spark, sf):
    return fund.usability(view(spark, sf, "b_reported"), "symbol",
                          F.col("capex").isNotNull() & F.coalesce(F.col("ebit") > 0, F.lit(False)))


@book.add("f2_f3_periods", "seq:i fiscal_year:i days:i annual:b quarter:b", """
SELECT seq, year(end_day) - CASE WHEN month(end_day) < 6 THEN 1 ELSE 0 END AS fiscal_year, end_day - s AS days,
       coalesce(end_day - s BETWEEN 330 AND 400, FALSE) AS annual, coalesce(end_day - s BETWEEN 60 AND 100, FALSE) AS quarter
FROM (SELECT *, CASE WHEN seq % 4 > 0 THEN start_day END AS s FROM b_facts) f""")
def periods(spark, sf):
    f = view(spark, sf, "b_facts")
    days = fn.duration_days(F.when(F.col("seq") % 4 > 0, F.col("start_day")), F.col("end_day"))
    return f.select("seq", fn.fiscal_year(F.col("end_day")).alias("fiscal_year"), days.alias("days"),
                    fn.in_window(days, dims.ANNUAL_DAYS).alias("annual"),
                    fn.in_window(days, dims.QUARTER_DAYS).alias("quarter"))
