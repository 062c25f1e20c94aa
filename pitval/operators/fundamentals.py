"""Derived fundamentals of reported periods (one row per symbol and period)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _zero_if_untagged(name: str, keys: Sequence[str]) -> Column:
    """A missing value counts as 0 only if the entity never reports the item at all."""
    never = F.max(name).over(Window.partitionBy(*keys)).isNull()
    return F.when(F.col(name).isNull() & never, F.lit(0.0)).otherwise(F.col(name).cast("double"))


def add_derived(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """EBIT with its origin, net debt, EBITDA, free cash flow, working capital, cost of debt, tax rate."""
    wanted = ("ebit", "pretax_income", "gross_profit", "operating_expenses", "costs_and_expenses", "revenue",
              "net_income", "da", "capex", "interest_expense", "income_tax_expense", "long_term_debt",
              "short_term_debt", "cash", "current_assets", "current_liabilities")
    for name in wanted:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
    zeroed = ("net_income", "da", "capex", "interest_expense", "income_tax_expense", "long_term_debt",
              "short_term_debt")
    df = df.withColumns({f"_{n}": _zero_if_untagged(n, keys) for n in zeroed})
    routes = {
        "operating_income": F.col("ebit"),
        "pretax_plus_interest": F.col("pretax_income") + F.col("_interest_expense"),
        "gross_profit_less_opex": F.col("gross_profit") - F.col("operating_expenses"),
        "revenue_less_costs": F.col("revenue") - F.col("costs_and_expenses"),
    }
    earlier = F.col("ebit_source") if "ebit_source" in df.columns else F.lit(None).cast("string")
    origin = F.coalesce(*[F.when(c.isNotNull(), F.lit(label)) for label, c in routes.items()])
    # an origin already known is kept while the tagged figure itself is there
    source = F.when(F.col("ebit").isNotNull(), F.coalesce(earlier, F.lit("operating_income"))) \
        .otherwise(F.coalesce(origin, earlier))
    df = df.withColumn("ebit_source", source).withColumn("ebit", F.coalesce(*routes.values()))
    debt = F.col("_long_term_debt") + F.col("_short_term_debt")
    parts = [F.coalesce(c, F.lit(0.0)) for c in ("long_term_debt", "short_term_debt", "cash")]
    any_part = F.coalesce("long_term_debt", "short_term_debt", "cash").isNotNull()
    before_tax = F.col("_net_income") + F.col("_income_tax_expense")
    df = df.withColumns({
        "net_debt": F.when(any_part, parts[0] + parts[1] - parts[2]),
        "ebitda": F.col("ebit") + F.col("_da"),
        "fcf": F.col("_net_income") + F.col("_da") - F.col("_capex"),
        "working_capital": F.col("current_assets") - F.col("current_liabilities"),
        "cost_of_debt": F.when(debt != 0, F.col("_interest_expense") / (debt + 1e-6)),
        "tax_rate": F.col("_income_tax_expense") / F.nullif(before_tax, F.lit(0.0)),
    })
    return df.drop(*[f"_{n}" for n in zeroed])


def working_capital_change(df: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("filed_date",)) -> DataFrame:
    """Change of working capital against the previously published period."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("working_capital_change", F.col("working_capital") - F.lag("working_capital").over(w))


def fill_rates(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Share of rows per group with a value, per column (long)."""
    agg = df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in columns])
    return agg.select(*group, "rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in columns])).alias("_c")) \
        .select(*group, "rows", "_c.*").withColumn("fill_rate", F.col("filled") / F.col("rows"))


def usability(df: DataFrame, key: str, usable: Column) -> DataFrame:
    """Keys with no usable row, with some, with all."""
    per = df.groupBy(key).agg(F.count_if(usable).alias("_u"), F.count(F.lit(1)).alias("_n"))
    label = F.when(F.col("_u") == 0, "none").when(F.col("_u") < F.col("_n"), "partial").otherwise("all")
    return per.groupBy(label.alias("coverage")).agg(F.count(F.lit(1)).alias("keys"))


def ttm_rows(quarters: DataFrame, flows: Sequence[str], stocks: Sequence[str] = (), keys: Sequence[str] = ("symbol",),
             require_contiguous: bool = False) -> DataFrame:
    """Trailing four quarters: flows summed (NULL if one is missing), stocks latest, newest filing date.

    ``quarters`` has one row per key and quarter. By default any four consecutive
    rows count; ``require_contiguous`` asks for adjacent quarters.
    """
    order = Window.partitionBy(*keys).orderBy("period_end", "fiscal_year", "fiscal_quarter")
    four = order.rowsBetween(-3, 0)
    index = F.col("fiscal_year") * 4 + F.substring("fiscal_quarter", 2, 1).cast("int")
    out = quarters.withColumns({
        "_rows": F.count(F.lit(1)).over(four), "_span": index - F.min(index).over(four),
        "_used": F.collect_list(F.concat(F.col("fiscal_year").cast("string"), F.col("fiscal_quarter"))).over(four),
        "filed_date": F.max("filed_date").over(four),
        **{m: F.when(F.count(m).over(four) == 4, F.sum(m).over(four)) for m in flows}})
    out = out.where("_rows = 4")
    if require_contiguous:
        out = out.where("_span = 3")
    return out.select(*[c for c in quarters.columns if c not in ("ttm_quarters_used", "period_type")],
                      F.lit("TTM").alias("period_type"), F.concat_ws(", ", "_used").alias("ttm_quarters_used"))
