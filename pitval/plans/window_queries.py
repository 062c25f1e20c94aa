"""Panel windows: bounded fill, returns, momentum, volatility, benchmark index, latest known state."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, ordering, panel, spans
from .bindings import VIEWS, View, raw, view
from .join_queries import grid, price_panel
from .registry import Book

book = Book()


@book.add("w4_bounded_fill", "symbol date:d close:f last_valid_date:d is_real:b", """
SELECT symbol, date, close, last_valid_date, raw_close IS NOT NULL AS is_real FROM b_panel""")
def bounded_fill(spark, sf):
    return price_panel(spark, sf)


@book.add("w5_returns", "symbol date:d ret:f6 log_ret:f6", """
SELECT symbol, date, close / lag(close) OVER w - 1 AS ret, ln(close) - ln(lag(close) OVER w) AS log_ret FROM b_panel
WINDOW w AS (PARTITION BY symbol ORDER BY pos)""")
def returns(spark, sf):
    return panel.returns(price_panel(spark, sf))


@book.add("w6_momentum", "symbol date:d momentum:f6", """
SELECT symbol, date, CASE WHEN lag(close, 252) OVER w > 0 THEN lag(close, 21) OVER w / lag(close, 252) OVER w - 1 END AS momentum
FROM b_panel WINDOW w AS (PARTITION BY symbol ORDER BY pos)""")
def momentum(spark, sf):
    return panel.momentum(price_panel(spark, sf))


VIEWS["b_known_closes"] = View("""
SELECT symbol, date, pos, close, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY pos)) AS lr,
       row_number() OVER (PARTITION BY symbol ORDER BY pos) AS n FROM b_panel WHERE close IS NOT NULL""")


@book.add("w7_realized_vol", "symbol date:d realized_vol:f", """
SELECT symbol, date, CASE WHEN count(lr) OVER f >= 5 AND n >= 30 THEN stddev_samp(lr) OVER f * sqrt(252) END AS realized_vol
FROM b_known_closes WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 58 PRECEDING AND CURRENT ROW)""")
def realized_vol(spark, sf):
    return panel.realized_vol(price_panel(spark, sf))


VIEWS["b_brand_spans"] = View("""
SELECT DISTINCT p_brand AS symbol, CASE WHEN CAST(substr(p_brand, 7, 2) AS INT) % 4 = 0 THEN CAST(NULL AS DATE)
         ELSE make_date(1992 + CAST(substr(p_brand, 7, 2) AS INT) % 4, 5, 1) END AS start_date,
       CASE WHEN CAST(substr(p_brand, 7, 2) AS INT) % 3 = 0 THEN CAST(NULL AS DATE)
         ELSE make_date(1997 + CAST(substr(p_brand, 7, 2) AS INT) % 3, 9, 1) END AS end_date
FROM {part}""")


@book.add("w14_equal_weight_index", "date:d mean_ret:f8 log_level:f6", """
SELECT date, mean_ret, ln(product(1 + coalesce(mean_ret, 0)) OVER (ORDER BY date)) AS log_level
FROM (SELECT r.date, avg(CASE WHEN (s.start_date IS NULL OR s.start_date <= r.date) AND (s.end_date IS NULL OR s.end_date > r.date)
                         THEN ret * 0.02 END) AS mean_ret
      FROM (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS ret FROM b_panel) r
      JOIN b_brand_spans s USING (symbol) GROUP BY r.date) d""")
def equal_weight_index(spark, sf):
    # the brand series jump wildly; damped so that the compounded level stays finite
    r = panel.returns(price_panel(spark, sf)).withColumn("ret", F.col("ret") * 0.02)
    return panel.equal_weight_index(spans.with_membership(r, view(spark, sf, "b_brand_spans"), "symbol", "date")) \
        .withColumn("log_level", F.ln("level"))


VIEWS["b_known_signal"] = View("""
SELECT g.ticker, g.date, s.published_date, s.event_id, s.gap_pct
FROM b_asof_grid g ASOF LEFT JOIN (SELECT symbol, published_date, max(event_id) AS event_id, max_by(gap_pct, event_id) AS gap_pct
                                   FROM b_signals GROUP BY 1, 2) s ON s.symbol = g.ticker AND g.date >= s.published_date""")


@book.add("w12_latest_known", "ticker date:d published_date:d event_id:i gap_pct:f",
          "SELECT ticker, date, published_date, event_id, gap_pct FROM b_known_signal")
def latest_known(spark, sf):
    s = view(spark, sf, "b_signals").select(F.col("symbol").alias("ticker"), "published_date", "event_id", "gap_pct")
    return asof.latest_known(grid(spark, sf), s, ["ticker"], "date", "published_date", ["event_id", "gap_pct"], "event_id",
                             matched="published_date")


@book.add("w17_top_per_group", "symbol rank:i date:d volume:f", """
SELECT symbol, rn AS rank, date, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, date) AS rn
FROM b_prices) p WHERE rn <= 5""")
def top_per_group(spark, sf):
    from pyspark.sql import Window
    order = [F.col("volume").desc(), F.col("date").asc()]
    top = ordering.top_k(view(spark, sf, "b_prices"), ["symbol"], order, 5)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(*order)))


@book.add("g16_exact_quantiles", "event_type n:i q25:f6 median:f6 q95:f6", """
SELECT event_type, count(value) AS n, quantile_cont(value, 0.25) AS q25, median(value) AS median,
       quantile_cont(value, 0.95) AS q95 FROM events GROUP BY event_type""")
def event_quantiles(spark, sf):
    return ordering.exact_quantiles(raw(spark, sf, "events"), ["event_type"], "value",
                                    {"q25": 0.25, "median": 0.5, "q95": 0.95}, count="n")


@book.add("o1_ranked_by_key", "o_orderpriority position:i o_orderkey:i", """
SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS position,
       o_orderkey FROM orders""")
def row_numbers(spark, sf):
    o = raw(spark, sf, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    return ordering.ranked(o, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], "position")
