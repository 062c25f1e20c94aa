"""Derived input tables over the supplied data, one definition for both engines.

Each view is portable SQL with ``{table}`` placeholders. Spark resolves them to
DataFrames, the oracle to common table expressions. Money is summed as exact
decimals before it becomes a double, so both engines start from equal numbers.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = tuple(SCHEMAS)


@dataclass(frozen=True)
class View:
    text: str

    def sql(self) -> str:
        """The text for the oracle: placeholders become names, doubled braces single ones."""
        plain = re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", self.text)
        return plain.replace("{{", "{").replace("}}", "}")

    def inputs(self) -> list[str]:
        return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", self.text)))


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A supplied table, read with its known schema so that no inference job runs."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str, seen: dict | None = None) -> DataFrame:
    seen = {} if seen is None else seen
    if name not in seen:
        if name in SCHEMAS:
            seen[name] = raw(spark, sf, name)
        else:
            v = VIEWS[name]
            seen[name] = spark.sql(v.text, **{t: view(spark, sf, t, seen) for t in v.inputs()})
    return seen[name]


def money(column: str) -> str:
    return f"CAST({column} AS DECIMAL(18,2))"


VIEWS: dict[str, View] = {
    "b_prices": View(f"""
SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date,
       CAST(sum({money('l_extendedprice')}) AS DOUBLE) / count(*) AS close,
       min(l_extendedprice) AS low, max(l_extendedprice) AS high,
       (min(l_extendedprice) + max(l_extendedprice)) / 2 AS open,
       CAST(sum({money('l_quantity')}) AS DOUBLE) AS volume
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey GROUP BY p_brand, CAST(l_shipdate AS DATE)"""),
    "b_prices_annual": View("""
SELECT symbol, year(date) AS year, max(date) AS date, max_by(close, date) AS close
FROM {b_prices} GROUP BY symbol, year(date)"""),
    "b_customer_year": View(f"""
SELECT o_custkey AS custkey, c_mktsegment AS sector, c_acctbal AS net_debt, year(o_orderdate) AS fiscal_year,
       CAST(sum({money('o_totalprice')}) AS DOUBLE) AS revenue,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN {money('o_totalprice')} END) AS DOUBLE) AS ebitda,
       coalesce(CAST(sum(CASE WHEN o_orderstatus = 'O' THEN {money('o_totalprice')} END) AS DOUBLE),
                CAST(0 AS DOUBLE)) AS open_value,
       CAST(max(o_orderdate) AS DATE) AS filed_date
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
GROUP BY o_custkey, c_mktsegment, c_acctbal, year(o_orderdate)"""),
    "b_financials": View("""
SELECT concat('C', CAST(custkey AS VARCHAR(20))) AS symbol, custkey, sector, 'FY' AS period_type, fiscal_year,
       fiscal_year AS year, CAST(NULL AS VARCHAR(2)) AS fiscal_quarter, revenue, ebitda,
       CAST(0.3 AS DOUBLE) * revenue - CAST(0.5 AS DOUBLE) * open_value AS net_income,
       CAST(1 + custkey % 90 AS DOUBLE) AS shares_outstanding, net_debt, filed_date, custkey AS tie_key,
       concat('Brand#', CAST(1 + custkey % 25 AS VARCHAR(20))) AS price_symbol
FROM {b_customer_year}"""),
    # the same filings with gaps by customer, for the derived-fundamentals rules
    "b_reported": View("""
SELECT symbol, custkey, fiscal_year, filed_date, tie_key, sector,
       CASE WHEN custkey % 7 = 0 THEN CAST(NULL AS DOUBLE) ELSE net_income * CAST(1.2 AS DOUBLE) END AS ebit,
       CASE WHEN custkey % 14 = 0 THEN CAST(NULL AS DOUBLE) ELSE net_income * CAST(1.1 AS DOUBLE) END AS pretax_income,
       CASE WHEN custkey % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE revenue * CAST(0.4 AS DOUBLE) END AS gross_profit,
       CASE WHEN custkey % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE revenue * CAST(0.1 AS DOUBLE) END AS operating_expenses,
       CASE WHEN custkey % 28 = 0 THEN CAST(NULL AS DOUBLE) ELSE revenue * CAST(0.8 AS DOUBLE) END AS costs_and_expenses,
       revenue, net_income,
       CASE WHEN custkey % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE revenue * CAST(0.05 AS DOUBLE) END AS da,
       CASE WHEN (custkey + fiscal_year) % 6 = 0 THEN CAST(NULL AS DOUBLE) ELSE revenue * CAST(0.06 AS DOUBLE) END AS capex,
       CASE WHEN custkey % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE revenue * CAST(0.02 AS DOUBLE) END AS interest_expense,
       CASE WHEN custkey % 13 = 0 THEN CAST(NULL AS DOUBLE) ELSE net_income * CAST(0.25 AS DOUBLE) END AS income_tax_expense,
       CASE WHEN custkey % 9 = 0 THEN CAST(NULL AS DOUBLE) ELSE revenue * CAST(0.3 AS DOUBLE) END AS long_term_debt,
       CASE WHEN custkey % 6 = 0 THEN CAST(NULL AS DOUBLE) ELSE revenue * CAST(0.1 AS DOUBLE) END AS short_term_debt,
       CASE WHEN custkey % 18 = 0 THEN CAST(NULL AS DOUBLE) ELSE net_debt END AS cash,
       CASE WHEN custkey % 10 = 0 THEN CAST(NULL AS DOUBLE) ELSE revenue * CAST(0.5 AS DOUBLE) END AS current_assets,
       revenue * CAST(0.2 AS DOUBLE) + net_debt AS current_liabilities,
       shares_outstanding, price_symbol
FROM {b_financials}"""),
    "b_quarters": View(f"""
SELECT custkey, concat('C', CAST(custkey AS VARCHAR(20))) AS symbol, fiscal_year, quarter, discrete, filed_date,
       CAST(sum(cents) OVER (PARTITION BY custkey, fiscal_year ORDER BY quarter) AS DOUBLE) AS cumulative
FROM (SELECT o_custkey AS custkey, year(o_orderdate) AS fiscal_year, quarter(o_orderdate) AS quarter,
             sum({money('o_totalprice')}) AS cents, CAST(sum({money('o_totalprice')}) AS DOUBLE) AS discrete,
             CAST(max(o_orderdate) AS DATE) AS filed_date
      FROM {{orders}} GROUP BY o_custkey, year(o_orderdate), quarter(o_orderdate)) AS q"""),
    "b_facts": View("""
SELECT o_custkey AS entity, 'revenue' AS metric, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
       make_date(year(o_orderdate), 1, 1) AS start_day,
       CASE WHEN o_orderkey % 7 = 0 THEN make_date(year(o_orderdate), 3, 31)
            ELSE make_date(year(o_orderdate), 12, 31) END AS end_day,
       CAST(o_orderdate AS DATE) AS filed, o_totalprice AS val,
       CASE WHEN o_orderstatus = 'P' THEN '10-Q' ELSE '10-K' END AS form,
       year(o_orderdate) AS fy, CASE WHEN o_orderstatus = 'P' THEN 'Q1' ELSE 'FY' END AS fp, o_orderkey AS seq
FROM {orders}"""),
    "b_member_events": View("""
SELECT concat('U', CAST(user_id AS VARCHAR(20))) AS ticker, CAST(ts AS DATE) AS date,
       CASE WHEN event_type = 'signup' THEN 'added' ELSE 'removed' END AS action, event_id AS seq
FROM {events} WHERE event_type IN ('signup', 'error')"""),
    "b_current": View("""
SELECT concat('U', CAST(user_id AS VARCHAR(20))) AS ticker,
       concat('Company ', CAST(user_id AS VARCHAR(20))) AS company_name, CAST(min(ts) AS DATE) AS date_added
FROM {events} WHERE user_id % 3 = 0 GROUP BY user_id"""),
    "b_signals": View("""
SELECT concat('U', CAST(user_id AS VARCHAR(20))) AS symbol, user_id, event_id, CAST(ts AS DATE) AS published_date,
       value - 50 AS gap_pct, CASE WHEN event_id % 2 = 0 THEN 'FY' ELSE 'TTM' END AS period_type,
       CAST(100 AS DOUBLE) AS close, CAST(100 AS DOUBLE) + (value - 50) AS theoretical,
       concat('S', CAST(user_id % 5 AS VARCHAR(20))) AS sector
FROM {events} WHERE event_type = 'purchase'"""),
    "b_material": View("""
SELECT concat('U', CAST(user_id AS VARCHAR(20))) AS symbol, CAST(ts AS DATE) AS filed_date,
       event_id AS accession, value, CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS BOOLEAN) ELSE event_id % 3 = 0 END
       AS materiality
FROM {events} WHERE event_type = 'error'"""),
    "b_nav_day": View(f"""
SELECT o_orderpriority AS run_id, CAST(o_orderdate AS DATE) AS date, count(*) AS num_positions,
       sum(CASE WHEN o_orderkey % 2 = 0 THEN {money('o_totalprice')} ELSE -{money('o_totalprice')} END) AS pnl
FROM {{orders}} GROUP BY o_orderpriority, CAST(o_orderdate AS DATE)"""),
    "b_nav": View("""
SELECT run_id, date, num_positions, 1000000 + CAST(sum(pnl) OVER (PARTITION BY run_id ORDER BY date) AS DOUBLE) / 100 AS nav,
       CAST(0.6 AS DOUBLE) * (1000000 + CAST(sum(pnl) OVER (PARTITION BY run_id ORDER BY date) AS DOUBLE) / 100)
       AS invested_value
FROM {b_nav_day}"""),
    "b_trades": View("""
SELECT o_orderpriority AS run_id, p_brand AS symbol, CAST(o_orderdate AS DATE) AS entry_date,
       CAST(o_orderdate AS DATE) + CAST(1 + 7 * l_quantity AS INT) AS exit_date, l_quantity AS shares,
       l_quantity AS contracts, l_extendedprice AS entry_price,
       l_extendedprice * (1 + l_tax - l_discount) AS exit_price,
       l_quantity * (l_extendedprice * (1 + l_tax - l_discount) - l_extendedprice) AS pnl,
       (l_tax - l_discount) * 100 AS return_pct, 1 + 7 * l_quantity AS holding_days,
       CASE WHEN l_returnflag = 'R' THEN 'PUT' ELSE 'CALL' END AS option_type,
       concat(l_returnflag, l_linestatus) AS exit_reason
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey"""),
    "b_exec": View("""
SELECT run_id, entry_date AS date, symbol, 'buy' AS side, option_type, contracts, entry_price AS price,
       CAST(100 AS DOUBLE) AS multiplier, exit_reason AS reason, CAST(0.65 AS DOUBLE) * contracts AS commission,
       CAST(0.001 AS DOUBLE) * entry_price * contracts AS slippage
FROM {b_trades}
UNION ALL
SELECT run_id, exit_date AS date, symbol, 'sell' AS side, option_type, contracts, exit_price AS price,
       CAST(100 AS DOUBLE) AS multiplier, exit_reason AS reason, CAST(0.65 AS DOUBLE) * contracts AS commission,
       CAST(0.001 AS DOUBLE) * exit_price * contracts AS slippage
FROM {b_trades}"""),
    "b_chain_raw": View("""
SELECT p_brand AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_date,
       CAST(950 AS DOUBLE) * (CAST(0.7 AS DOUBLE) + CAST(0.012 AS DOUBLE) * l_quantity) AS strike,
       30 + 20 * p_size AS tenor_days, CASE WHEN l_returnflag = 'R' THEN 'PUT' ELSE 'CALL' END AS option_type,
       CAST(l_discount AS DECIMAL(18,2)) AS discount, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
       CAST(l_quantity AS DECIMAL(18,2)) AS quantity
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""),
    "b_chain": View("""
SELECT symbol, snapshot_date, strike, tenor_days, option_type, CAST(950 AS DOUBLE) AS spot,
       snapshot_date + CAST(tenor_days AS INT) AS expiry, iv, mid, mid * CAST(0.98 AS DOUBLE) AS bid,
       mid * CAST(1.02 AS DOUBLE) AS ask, mid AS last_price, volume, open_interest,
       (strike / 950 - 1) * 100 AS moneyness_pct
FROM (SELECT symbol, snapshot_date, strike, tenor_days, option_type,
             CAST(0.10 AS DOUBLE) + 4 * (CAST(sum(discount) AS DOUBLE) / count(*)) AS iv,
             CAST(sum(price) AS DOUBLE) / count(*) / 1000 + 1 AS mid,
             count(*) AS volume, CAST(sum(quantity) AS DOUBLE) AS open_interest
      FROM {b_chain_raw} GROUP BY symbol, snapshot_date, strike, tenor_days, option_type) AS g"""),
    "b_docs": View("""
SELECT doc_id, source, lang, concat('Item ', CAST(1 + doc_id % 9 AS VARCHAR(20)), '.0',
       CAST(doc_id % 5 AS VARCHAR(20)), ' ', text, ' item 5.02') AS text
FROM {documents}"""),
}
