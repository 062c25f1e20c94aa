"""Performance, ledger, cost and audit analytics over finished runs.

An equity curve has one row per (run, day), so its windows are bounded by the
calendar; trades and fills are only ever aggregated, with map-side combine.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import dims
from ..session import cut, keep
from .asof import Lookup, asof_join, asof_lookup
from .ordering import exact_quantiles
from .spans import with_membership

YEAR = 365.25
TRADING_DAYS = 252.0


def _run(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("date")


def daily_returns(equity: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    before = F.lag("nav").over(_run(keys))
    return equity.withColumn("ret", F.col("nav") / F.nullif(before, F.lit(0.0)) - 1)


def daily_rate(df: DataFrame, rates: DataFrame, date: str = "date", default: float = dims.RISK_FREE_DEFAULT) -> DataFrame:
    """Rate of the row's own year per trading day: an ex-post measure, not a decision."""
    r = F.broadcast(rates.select(F.col("year").alias("_y"), F.col("rate").alias("_r")))
    return df.join(r, F.year(date) == F.col("_y"), "left") \
        .withColumn("rf_daily", F.coalesce("_r", F.lit(default)) / TRADING_DAYS).drop("_y", "_r")


def drawdowns(equity: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Running peak, drawdown and the number of the episode a day belongs to."""
    w = _run(keys).rowsBetween(Window.unboundedPreceding, 0)
    out = equity.withColumn("peak", F.max("nav").over(w))
    out = out.withColumns({"drawdown": F.col("nav") / F.col("peak") - 1, "in_drawdown": F.col("nav") < F.col("peak")})
    return out.withColumn("episode", F.sum(F.when(F.col("in_drawdown"), 0).otherwise(1)).over(w))


def longest_drawdown(equity: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    dd = drawdowns(equity, keys)
    spells = dd.where("in_drawdown").groupBy(*keys, "episode").agg((F.datediff(F.max("date"), F.min("date")) + 1).alias("days"))
    worst = dd.groupBy(*keys).agg((F.min("drawdown") * 100).alias("max_drawdown_pct"))
    return worst.join(spells.groupBy(*keys).agg(F.max("days").alias("_d")), list(keys), "left") \
        .withColumn("max_drawdown_duration_days", F.coalesce("_d", F.lit(0))).drop("_d")


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def run_metrics(equity: DataFrame, rates: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Return, risk and exposure measures of every run in one job."""
    keys = list(keys)
    d = daily_rate(daily_returns(equity, keys), rates).withColumn("excess", F.col("ret") - F.col("rf_daily"))
    # a run has one return per day: its quantile is bounded by the calendar
    tail = d.groupBy(*keys).agg(F.percentile("ret", 0.05).alias("_q05"))
    cvar = d.join(tail, keys).where("ret <= _q05").groupBy(*keys).agg(F.avg("ret").alias("_cvar"), F.first("_q05").alias("_q05"))
    m = d.groupBy(*keys).agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.min_by("nav", "date").alias("initial_nav"),
        F.max_by("nav", "date").alias("final_nav"), F.avg("nav").alias("avg_nav"), F.count("ret").alias("_n"),
        F.stddev_samp("ret").alias("_vol"), F.avg("excess").alias("_mean"), F.stddev_samp("excess").alias("_sd"),
        F.sqrt(F.avg(F.when(F.col("excess") < 0, F.pow("excess", 2.0)).when(F.col("excess") >= 0, 0.0))).alias("_down"), F.skewness("ret").alias("_g1"),
        F.kurtosis("ret").alias("_g2"), F.max("ret").alias("_best"), F.min("ret").alias("_worst"),
        F.avg("num_positions").alias("avg_num_positions"), F.max("num_positions").alias("max_num_positions"),
        (F.avg(F.col("invested_value") / F.col("nav")) * 100).alias("avg_exposure_pct"))
    m = m.join(longest_drawdown(equity, keys), keys).join(cvar, keys, "left")
    n, root = F.col("_n").cast("double"), F.sqrt(F.lit(TRADING_DAYS))
    years = _positive(F.datediff("end_date", "start_date") / YEAR)
    growth = F.col("final_nav") / F.nullif(F.col("initial_nav"), F.lit(0.0))
    m = m.withColumns({"n_years": years, "total_return_pct": (growth - 1) * 100,
                       "cagr_pct": (F.pow(growth, 1 / years) - 1) * 100})
    return m.withColumns({
        "annualized_volatility_pct": F.col("_vol") * root * 100,
        "sharpe_ratio": F.col("_mean") / _positive(F.col("_sd")) * root,
        "sortino_ratio": F.when(n > 1, F.col("_mean") / _positive(F.col("_down")) * root),
        "calmar_ratio": F.col("cagr_pct") / F.nullif(F.abs("max_drawdown_pct"), F.lit(0.0)),
        "var_95_daily_pct": F.when(n > 1, F.col("_q05") * 100), "cvar_95_daily_pct": F.when(n > 1, F.col("_cvar") * 100),
        # sample-corrected moments from the population ones
        "skewness_daily_returns": F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)),
        "kurtosis_daily_returns": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)),
        "best_day_pct": F.col("_best") * 100, "worst_day_pct": F.col("_worst") * 100,
    }).drop("_n", "_vol", "_mean", "_sd", "_down", "_g1", "_g2", "_best", "_worst", "_q05", "_cvar")


def trade_metrics(trades: DataFrame, keys: Sequence[str] = ("run_id",), metrics: DataFrame | None = None) -> DataFrame:
    """Win rate, averages, profit factor; turnover if the run metrics are at hand."""
    pnl = F.col("pnl")
    out = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_trades"), (F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)) * 100).alias("win_rate_pct"),
        F.avg(F.when(pnl > 0, F.col("return_pct"))).alias("avg_win_pct"),
        F.avg(F.when(pnl < 0, F.col("return_pct"))).alias("avg_loss_pct"), F.avg("return_pct").alias("avg_trade_return_pct"),
        F.max("return_pct").alias("best_trade_pct"), F.min("return_pct").alias("worst_trade_pct"),
        (F.sum(F.when(pnl > 0, pnl).otherwise(0.0)) / _positive(-F.sum(F.when(pnl < 0, pnl).otherwise(0.0)))).alias("profit_factor"),
        F.avg("holding_days").alias("avg_holding_days"),
        F.sum(F.col("shares") * (F.col("entry_price") + F.col("exit_price"))).alias("turnover_dollar"))
    if metrics is not None:
        out = out.join(metrics.select(*keys, "avg_nav", "n_years"), list(keys)) \
            .withColumn("annualized_turnover_pct", F.col("turnover_dollar") / F.col("avg_nav") / F.col("n_years") * 100)
    return out


def exits_by_reason(trades: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return trades.groupBy(*keys, "exit_reason").agg(F.count(F.lit(1)).alias("exits"))


def thesis_metrics(trades: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """The same trades per thesis (symbol, entry day) instead of per sale."""
    per = trades.groupBy(*keys, "symbol", "entry_date").agg(F.sum("pnl").alias("pnl"), F.max("holding_days").alias("holding"))
    pnl = F.col("pnl")
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_positions_closed"),
        (F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)) * 100).alias("win_rate_positions_pct"),
        (F.sum(F.when(pnl > 0, pnl).otherwise(0.0)) / _positive(-F.sum(F.when(pnl < 0, pnl).otherwise(0.0)))).alias("profit_factor_positions"),
        F.avg("holding").alias("avg_holding_days_positions"))


def benchmark_metrics(equity: DataFrame, benchmark: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Benchmark (date, level) carried onto each run's calendar; nothing with fewer than two real points inside."""
    keys = list(keys)
    span = equity.groupBy(*keys).agg(F.min("date").alias("_a"), F.max("date").alias("_z"))
    days = benchmark.where("level is not null")
    inside = asof_range_count(span, days, keys)
    aligned = with_level(equity, days)
    w = _run(keys)
    r = aligned.withColumns({"_s": F.col("nav") / F.nullif(F.lag("nav").over(w), F.lit(0.0)) - 1,
                             "_b": F.col("level") / F.nullif(F.lag("level").over(w), F.lit(0.0)) - 1})
    known = F.col("level").isNotNull()
    pair = F.col("_s").isNotNull() & F.col("_b").isNotNull()
    gap = F.when(pair, F.col("_s") - F.col("_b"))
    m = r.groupBy(*keys).agg(
        F.min_by("nav", "date").alias("_n0"), F.max_by("nav", "date").alias("_n1"), F.datediff(F.max("date"), F.min("date")).alias("_days"),
        F.min_by("level", F.when(known, F.col("date"))).alias("_b0"), F.max_by("level", F.when(known, F.col("date"))).alias("_b1"),
        F.covar_samp(F.when(pair, F.col("_s")), F.when(pair, F.col("_b"))).alias("_cov"),
        F.var_samp(F.when(pair, F.col("_b"))).alias("_var"), F.avg(gap).alias("_gap"), F.stddev_samp(gap).alias("_te"),
        F.corr(F.when(pair, F.col("_s")), F.when(pair, F.col("_b"))).alias("correlation"))
    years = _positive(F.col("_days") / YEAR)
    b, s = F.col("_b1") / _positive(F.col("_b0")), F.col("_n1") / F.nullif(F.col("_n0"), F.lit(0.0))
    cagr = (F.pow(b, 1 / years) - 1) * 100
    m = m.join(inside, keys).where("_points >= 2").where("_b0 > 0")
    return m.select(*keys, ((b - 1) * 100).alias("benchmark_total_return_pct"), cagr.alias("benchmark_cagr_pct"),
                    ((F.pow(s, 1 / years) - 1) * 100 - cagr).alias("alpha_pct"),
                    (F.col("_cov") / _positive(F.col("_var"))).alias("beta"), "correlation",
                    (F.col("_te") * F.sqrt(F.lit(TRADING_DAYS)) * 100).alias("tracking_error_pct"),
                    (F.col("_gap") / _positive(F.col("_te")) * F.sqrt(F.lit(TRADING_DAYS))).alias("information_ratio"))


def asof_range_count(span: DataFrame, days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Real benchmark days within each run's span, from their running number at both ends."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    numbered = days.select("date").distinct().withColumn("_no", F.row_number().over(w)).withColumn("_all", F.lit(0))
    s = span.withColumn("_all", F.lit(0))
    s = asof_join(s, numbered.select("_all", F.col("date").alias("_d"), F.col("_no").alias("_upto")), ["_all"], "_z", "_d", ["_upto"])
    s = asof_join(s, numbered.select("_all", F.col("date").alias("_d"), F.col("_no").alias("_before")), ["_all"], "_a", "_d",
                  ["_before"], strict=True)
    return s.select(*keys, (F.coalesce("_upto", F.lit(0)) - F.coalesce("_before", F.lit(0))).alias("_points"))


# -- positions --------------------------------------------------------------------------


def month_marks(day: int = 28):
    """The given day of every month from a first date on, before a second one."""
    def marks(start: Column, stop: Column) -> Column:
        first = F.make_date(F.year(start), F.month(start), F.lit(day))
        first = F.when(first < start, F.add_months(first, 1)).otherwise(first)
        last = F.date_sub(stop, 1)
        return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))
    return marks


def positions_on(trades: DataFrame, keys: Sequence[str], amounts: dict[str, Column], entered: str = "entry_date", left: str = "exit_date",
                 marks=None, upto: Column | None = None) -> DataFrame:
    """``keys, date``, the sums of ``amounts`` and ``n_open``: what is held on each mark, for positions of any length.

    A trade is held from the day it is entered until the day before it is left. Instead of
    meeting every mark, it adds its amounts on one day and takes them back on another.
    These changes are summed per key and day (combined before the shuffle), a running sum
    over the days gives what is held from one change to the next, and each such stretch names
    its own marks (``month_marks`` by default). So work grows with changes and result rows, not
    with trades times marks. Give amounts as integers or decimals where sums must be exact.
    A trade without an exit is held up to ``upto``, if given. Keys may be null.
    """
    keys, marks = list(keys), marks or month_marks()
    sized = trades.where(F.col(entered).isNotNull()).select(*keys, F.to_date(entered).alias("_in"), F.to_date(left).alias("_out"), *[c.alias(n) for n, c in amounts.items()])
    changes = sized.select(*keys, F.inline(F.array(*[
        F.struct(F.col(day).alias("_day"), F.lit(sign).cast("long").alias("n_open"), *[(F.col(n) * sign).alias(n) for n in amounts])
        for day, sign in (("_in", 1), ("_out", -1))]))).where("_day is not null")
    daily = changes.groupBy(*keys, "_day").agg(*[F.sum(n).alias(n) for n in ("n_open", *amounts)])
    days = Window.partitionBy(*keys).orderBy("_day")  # one row per key and day
    held = daily.withColumns({n: F.sum(n).over(days.rowsBetween(Window.unboundedPreceding, 0)) for n in ("n_open", *amounts)} | {
        "_next": F.coalesce(F.lead("_day").over(days), *([upto] if upto is not None else []))})
    return held.where("n_open > 0").select(*keys, F.explode(marks(F.col("_day"), F.col("_next"))).alias("date"), *amounts, "n_open")


# -- sides ------------------------------------------------------------------------------


def side_curves(equity: DataFrame, trades: DataFrame, positions: DataFrame, initial: DataFrame | None = None,
                keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Synthetic NAV of each option side: initial capital + realised so far + unrealised.

    Also carries side ``ALL``. Each curve has exactly the run's calendar.
    """
    keys = list(keys)
    start = initial if initial is not None else equity.groupBy(*keys).agg(F.min_by("nav", "date").alias("initial_nav"))
    sides = F.explode(F.array(F.lit("ALL"), F.lit("CALL"), F.lit("PUT")))
    calendar = equity.select(*keys, "date", sides.alias("side"))
    both = F.explode(F.array(F.lit("ALL"), F.col("option_type"))).alias("side")
    # one pass over the trades by side; the whole is added up from the sides
    closed = trades.groupBy(*keys, "option_type", F.col("exit_date").alias("_exit")).agg(F.sum("pnl").alias("pnl"))
    closed = closed.select(*keys, both, "_exit", "pnl").groupBy(*keys, "side", "_exit").agg(F.sum("pnl").alias("pnl"))
    run = Window.partitionBy(*keys, "side").orderBy("_exit").rowsBetween(Window.unboundedPreceding, 0)
    booked = closed.withColumn("realized_pnl_cumul", F.sum("pnl").over(run))
    out = asof_join(calendar, booked, [*keys, "side"], "date", "_exit", ["realized_pnl_cumul"])
    held = positions.groupBy(*keys, "option_type", "date").agg(
        F.sum("unrealized_pnl").alias("u"), F.sum("market_value").alias("v"), F.count(F.lit(1)).alias("n"))
    open_ = held.select(*keys, both, "date", "u", "v", "n").groupBy(*keys, "side", "date").agg(
        F.sum("u").alias("unrealized_pnl"), F.sum("v").alias("invested_value"), F.sum("n").alias("num_positions"))
    out = out.join(open_, [*keys, "side", "date"], "left").join(start, keys)
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("realized_pnl_cumul", "unrealized_pnl", "invested_value")}
    out = out.withColumns({**zero, "num_positions": F.coalesce("num_positions", F.lit(0))})
    return out.withColumn("nav", F.col("initial_nav") + F.col("realized_pnl_cumul") + F.col("unrealized_pnl"))


def reconciliation(equity: DataFrame, curves: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Largest and last gap between the reported NAV (less cash interest) and the rebuilt one."""
    interest = F.coalesce("total_cash_interest", F.lit(0.0)) if "total_cash_interest" in equity.columns else F.lit(0.0)
    own = equity.select(*keys, "date", (F.col("nav") - interest).alias("_nav"))
    both = own.join(curves.where("side = 'ALL'").select(*keys, "date", "nav", "initial_nav"), [*keys, "date"])
    gap = F.col("_nav") - F.col("nav")
    return both.groupBy(*keys).agg(F.max(F.abs(gap)).alias("max_abs_residual_dollar"),
                                   (F.max(F.abs(gap)) / F.nullif(F.max("initial_nav"), F.lit(0.0)) * 100).alias("max_abs_residual_pct_of_initial"),
                                   F.max_by(gap, "date").alias("final_residual_dollar"))


def _with_total(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], side: str = "option_type") -> DataFrame:
    """CALL, PUT and ALL in one aggregation; rows of another side count in ALL only."""
    out = df.groupingSets([[*[F.col(k) for k in keys], F.col(side)], [F.col(k) for k in keys]], *[F.col(k) for k in keys], F.col(side)) \
        .agg(F.grouping(side).alias("_all"), *aggs)
    return out.withColumn("side", F.when(F.col("_all") == 1, "ALL").otherwise(F.col(side))) \
        .where(F.col("side").isin("ALL", "CALL", "PUT")).drop("_all", side)


def volume_breakdown(trades: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Trades, contracts, notionals and realised P&L by side, with their percent of ALL."""
    bought, sold = F.col("shares") * F.col("entry_price"), F.col("shares") * F.col("exit_price")
    parts = {"num_trades": F.count(F.lit(1)), "contracts_traded": F.sum("contracts"), "entry_notional_dollar": F.sum(bought),
             "exit_notional_dollar": F.sum(sold), "turnover_dollar": F.sum(bought) + F.sum(sold), "realized_pnl_dollar": F.sum("pnl")}
    out = _with_total(trades, keys, [c.alias(n) for n, c in parts.items()])
    w = Window.partitionBy(*keys)  # three rows per run
    return out.withColumns({f"{n}_pct": F.col(n) * 100.0 / F.nullif(F.max(F.when(F.col("side") == "ALL", F.col(n))).over(w).cast("double"), F.lit(0.0))
                            for n in parts})


def cost_breakdown(executions: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    out = _with_total(executions, keys, [
        F.count(F.lit(1)).alias("num_fills"), F.count_if(F.col("side") == "buy").alias("num_buys"),
        F.count_if(F.col("side") == "sell").alias("num_sells"), F.sum("contracts").alias("contracts_traded"),
        F.sum("commission").alias("commission_dollar"), F.sum("slippage").alias("slippage_dollar"),
        F.sum(F.col("contracts") * F.col("multiplier") * F.col("price")).alias("_traded")])
    return out.withColumn("friction_dollar", F.col("commission_dollar") + F.col("slippage_dollar")) \
        .withColumn("friction_pct_of_turnover", F.col("friction_dollar") / F.nullif(F.col("_traded"), F.lit(0.0)) * 100).drop("_traded")


def cost_by_reason(executions: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    out = executions.groupBy(*keys, "reason").agg(
        F.count(F.lit(1)).alias("num_fills"), F.sum("contracts").alias("contracts_traded"),
        F.sum("commission").alias("commission_dollar"), F.sum("slippage").alias("slippage_dollar"))
    out = out.withColumn("friction_dollar", F.col("commission_dollar") + F.col("slippage_dollar"))
    total = F.sum("friction_dollar").over(Window.partitionBy(*keys))  # a row per reason
    return out.withColumn("pct_of_friction", F.col("friction_dollar") / F.nullif(total, F.lit(0.0)) * 100)


def valuation_breakdown(positions: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Average and peak value, positions and days of exposure by side, over all position days."""
    keys = list(keys)
    daily = positions.groupBy(*keys, "date").agg(*[x for s in ("CALL", "PUT") for x in (
        F.sum(F.when(F.col("option_type") == s, F.col("market_value")).otherwise(0.0)).alias(f"v_{s}"),
        F.count_if(F.col("option_type") == s).alias(f"n_{s}"))])
    rows = daily.select(*keys, "date", (F.col("v_CALL") + F.col("v_PUT")).alias("_both"), F.explode(F.array(*[
        F.struct(F.lit(s).alias("side"), F.col(f"v_{s}").alias("v"), F.col(f"n_{s}").alias("n")) for s in ("CALL", "PUT")])).alias("_s")) \
        .select(*keys, "_both", "_s.*")
    return rows.groupBy(*keys, "side").agg(
        F.avg("v").alias("avg_market_value_dollar"), (F.avg("v") / F.nullif(F.avg("_both"), F.lit(0.0)) * 100).alias("pct_of_avg_invested"),
        F.max("v").alias("max_market_value_dollar"), F.avg("n").alias("avg_num_positions"), F.max("n").alias("max_num_positions"),
        F.count_if(F.col("n") > 0).alias("days_with_exposure"),
        (F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)) * 100).alias("pct_of_days_with_exposure"))


def quantity_reconciliation(executions: DataFrame, positions: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Bought less sold less still held must be zero per side."""
    keys = list(keys)
    flows = executions.groupBy(*keys, "option_type").agg(
        F.sum(F.when(F.col("side") == "buy", F.col("contracts")).otherwise(0.0)).alias("bought"),
        F.sum(F.when(F.col("side") == "sell", F.col("contracts")).otherwise(0.0)).alias("sold"))
    last = positions.groupBy(*keys).agg(F.max("date").alias("date"))
    held = positions.join(last, [*keys, "date"]).groupBy(*keys, "option_type").agg(F.sum("contracts").alias("held"))
    out = flows.join(held, [*keys, "option_type"], "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
    return out.withColumn("gap", F.col("bought") - F.col("sold") - F.col("held"))


def pnl_by_exit_reason(trades: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    g = [*keys, "option_type", "exit_reason"]
    trades = keep(trades.select(*g, "pnl", "return_pct", "holding_days"))  # read three times
    out = trades.groupBy(*g).agg(
        F.count(F.lit(1)).alias("num_trades"), F.sum("pnl").alias("pnl_dollar"), F.avg("return_pct").alias("avg_return_pct"),
        (F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)) * 100).alias("win_rate_pct"), F.avg("holding_days").alias("avg_holding_days"))
    return out.join(exact_quantiles(trades, g, "return_pct", {"median_return_pct": 0.5}), g, "left")


def annual_pnl(trades: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    out = trades.groupBy(*keys, F.year("exit_date").alias("exit_year")).pivot("option_type", ["CALL", "PUT"]).agg(F.sum("pnl"))
    return out.fillna(0.0, ["CALL", "PUT"]).withColumn("TOTAL", F.col("CALL") + F.col("PUT"))


def metric_table(metrics: DataFrame, run: str, runs: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per metric, one column per run; metrics nobody has are left out."""
    long = metrics.select(run, F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_m")).select(run, "_m.*")
    wide = long.groupBy("metric").pivot(run, list(runs)).agg(F.first("value"))
    return wide.where(F.coalesce(*[F.col(f"`{r}`") for r in runs]).isNotNull())


# -- audit ------------------------------------------------------------------------------


def with_level(equity: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The benchmark (date, level) carried onto the days of every run. One series serves all
    runs, so the look-up key is constant and its marks are one per day."""
    series = benchmark.where("level is not null").select(F.lit(0).alias("_all"), F.col("date").alias("_d"), "level")
    return asof_join(equity.withColumn("_all", F.lit(0)), series, ["_all"], "date", "_d", ["level"]).drop("_all")


def against(measure, equity: DataFrame, benchmark: DataFrame, value: str, on: Sequence[str], **options) -> DataFrame:
    """A measure of the run beside the same measure of the benchmark, and their difference."""
    own = measure(equity, **options)
    level = with_level(equity, benchmark).withColumn("nav", F.col("level"))
    other = measure(level, **options).select(*on, F.col(value).alias(f"benchmark_{value}"))
    return own.join(other, list(on), "left").withColumn("difference", F.col(value) - F.col(f"benchmark_{value}"))


def calendar_year_returns(equity: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    known = F.when(F.col("nav").isNotNull(), F.col("date"))
    per = equity.groupBy(*keys, F.year("date").alias("year")).agg(F.min_by("nav", known).alias("_a"), F.max_by("nav", known).alias("_z"))
    return per.select(*keys, "year", ((F.col("_z") / F.col("_a") - 1) * 100).alias("return_pct"))


def window_growth(equity: DataFrame, windows: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """CAGR between the first and last observation inside each (start, end) window of a run."""
    look = equity.where("nav is not null").select(*keys, F.col("date").alias("_d"), "nav")
    out = asof_lookup(windows, keys, "window_start", [Lookup(look.withColumnRenamed("nav", "_n0"), "_d", ["_n0"], matched="_d0")], "forward")
    out = asof_lookup(out, keys, "window_end", [Lookup(look.withColumnRenamed("nav", "_n1"), "_d", ["_n1"], matched="_d1")])
    years = _positive(F.datediff("_d1", "_d0") / YEAR)
    return out.withColumn("cagr_pct", F.when(F.col("_n0") > 0, (F.pow(F.col("_n1") / F.col("_n0"), 1 / years) - 1) * 100)) \
        .drop("_n0", "_n1", "_d0", "_d1")


def rolling_windows(equity: DataFrame, years: int = 5, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Windows of ``years`` stepping one year while they end within the run."""
    span = equity.groupBy(*keys).agg(F.min("date").alias("_a"), F.max("date").alias("_z"))
    steps = F.floor(F.months_between("_z", "_a") / 12) - years
    w = span.where(steps >= 0).withColumn("_k", F.explode(F.sequence(F.lit(0), steps.cast("int"))))
    w = w.withColumns({"window_start": F.add_months("_a", F.col("_k") * 12),
                       "window_end": F.add_months(F.add_months("_a", F.col("_k") * 12), F.lit(12 * years))})
    return window_growth(equity, w.where("window_end <= _z").drop("_a", "_z", "_k"), keys)


def shifted_starts(equity: DataFrame, shifts: Sequence[int] = (0, 1, 2, 3, 5), keys: Sequence[str] = ("run_id",)) -> DataFrame:
    span = equity.groupBy(*keys).agg(F.min("date").alias("_a"), F.max("date").alias("window_end"))
    w = span.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts]))) \
        .withColumn("window_start", F.add_months("_a", F.col("shift") * 12)).where("window_start < window_end").drop("_a")
    return window_growth(equity, w, keys)


def split_labels(equity: DataFrame, fraction: float, keys: Sequence[str] = ("run_id",), least: int = 20) -> DataFrame:
    """Label days train or test around the date at ``fraction`` of a run; short runs get no label."""
    w = _run(keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = equity.withColumns({"_i": F.row_number().over(w) - 1, "_n": n})
    label = F.when(F.col("_i") <= F.floor(F.col("_n") * fraction), "train").otherwise("test")
    return out.where(F.col("_n") >= least).withColumn("split", label).drop("_i", "_n")


def split_trades(trades: DataFrame, labelled: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Trades labelled by their exit against the last training day of their run."""
    border = labelled.where("split = 'train'").groupBy(*keys).agg(F.max("date").alias("_border"))
    return trades.join(border, list(keys)).withColumn("split", F.when(F.col("exit_date") <= F.col("_border"), "train").otherwise("test")) \
        .drop("_border")


def objective_correlations(results: DataFrame, parameters: Sequence[str], objective: str) -> DataFrame:
    """Correlation of each numeric parameter with the objective over all runs (long)."""
    wide = results.agg(*[F.corr(p, objective).alias(p) for p in parameters])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).alias("correlation")) for p in parameters]))
                       .alias("c")).select("c.*")


def cost_sensitivity(metrics: DataFrame, turnover: DataFrame, applied_bps: float = 10.0, levels: Sequence[float] = (20.0, 30.0, 50.0),
                     keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """CAGR if every traded dollar had cost more basis points."""
    m = metrics.join(turnover.select(*keys, "turnover_dollar"), list(keys)).withColumn(
        "bps", F.explode(F.array(*[F.lit(float(b)) for b in (applied_bps, *levels)])))
    m = m.withColumn("extra_cost_dollar", F.col("turnover_dollar") * (F.col("bps") - applied_bps) / 10_000)
    left = F.col("final_nav") - F.col("extra_cost_dollar")
    return m.withColumn("cagr_approx_pct", F.when(left > 0, (F.pow(left / F.col("initial_nav"), 1 / F.col("n_years")) - 1) * 100)) \
        .select(*keys, "bps", "extra_cost_dollar", "cagr_approx_pct")


def friction_plan(cases: DataFrame) -> DataFrame:
    """Nominal and friction-free P&L of a 2x2 plan (slippage_zero, daily) and what each friction costs."""
    def at(zero: bool, daily: bool) -> Column:
        return F.max(F.when((F.col("slippage_zero") == zero) & (F.col("daily") == daily), F.col("pnl")))
    p = cases.agg(at(False, True).alias("nominal"), at(True, False).alias("pure_thesis"), at(True, True).alias("_s"), at(False, False).alias("_c"))
    return p.select("nominal", "pure_thesis", (F.col("_s") - F.col("nominal")).alias("slippage_cost"),
                    (F.col("_c") - F.col("nominal")).alias("churn_cost"))


def rank_runs(results: DataFrame, objective: str, min_trades: int, top: int | None = None) -> DataFrame:
    """Best first by the training objective (by the plain one where no run has it), without failed or thin runs."""
    usable = results.where(F.col("error").isNull() & (F.coalesce("num_trades", F.lit(0)) >= min_trades))
    trained = f"train_{objective}"
    if trained in results.columns:
        any_trained = usable.agg(F.count(trained) > 0).scalar()
        key = F.when(any_trained, F.col(trained)).otherwise(F.col(objective))
    else:
        key = F.col(objective)
    ordered = usable.withColumn("_key", key).orderBy(F.col("_key").desc_nulls_last(), F.col("run_id"))
    return (ordered.limit(top) if top else ordered).drop("_key")


def best_eligible(results: DataFrame, objective: str, eligible: Column, top: int) -> DataFrame:
    """Top rows among the eligible ones, among all when none is."""
    some = results.agg(F.coalesce(F.bool_or(eligible), F.lit(False))).scalar()
    return results.where(~some | eligible) \
        .orderBy(F.col(objective).desc_nulls_last(), F.col("run_id")).limit(top)


def buys_from_positions(positions: DataFrame, signals: DataFrame | None = None, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Buys read off rising quantities; a day of the run without the symbol counts as zero held.

    New positions are explained by the latest signal known that day.
    """
    days = positions.select(*keys, "date").distinct()
    days = days.withColumn("_pos", F.row_number().over(_run(keys)))
    w = Window.partitionBy(*keys, "symbol").orderBy("date")
    p = positions.join(days, [*keys, "date"])
    held = F.when(F.lag("_pos").over(w) == F.col("_pos") - 1, F.lag("contracts").over(w))
    p = p.withColumn("_prev", F.coalesce(held, F.lit(0.0))).where(F.col("contracts") > F.col("_prev") + 1e-9)
    out = p.select(*keys, "date", "symbol", (F.col("contracts") - F.col("_prev")).alias("bought"), (F.col("_prev") <= 1e-9).alias("is_new"))
    if signals is None:
        return out.withColumn("reason", F.when(F.col("is_new"), "new_position").otherwise("added"))
    out = asof_join(out, signals.select("symbol", F.col("date").alias("_sd"), "gap_pct"), ["symbol"], "date", "_sd", ["gap_pct"])
    reason = F.when(~F.col("is_new"), "added").when(F.col("gap_pct").isNull(), "new_position") \
        .when(F.col("gap_pct") > 0, "signal_undervalued").otherwise("signal_overvalued")
    return out.withColumn("reason", reason)


def coverage_over_time(dates: DataFrame, spans: DataFrame, signals: DataFrame, key: str = "ticker") -> DataFrame:
    """Per date: members, members with a signal by then, split into current and former members."""
    first = signals.groupBy(key).agg(F.min("published_date").alias("_first"))
    status = spans.groupBy(key).agg(F.bool_or("is_current_member").alias("is_current_member"))
    m = with_membership(dates, spans, key, "date").where("is_member")
    m = m.join(first, key, "left").join(status, key)
    have = F.coalesce(F.col("_first") <= F.col("date"), F.lit(False))
    return m.groupBy("date").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(have).alias("with_signal"),
        (F.avg(F.when(have, 1.0).otherwise(0.0)) * 100).alias("ratio_pct"),
        F.count_if(F.col("is_current_member")).alias("current_members"),
        F.count_if(F.col("is_current_member") & have).alias("current_with_signal"),
        F.count_if(~F.col("is_current_member") & have).alias("former_with_signal"))


def freshness(newest: DataFrame, as_of, stale_after_days: int = 100) -> DataFrame:
    """``newest``: (table_name, last_update); status by age."""
    age = F.datediff(F.lit(as_of).cast("date"), "last_update")
    return newest.withColumn("age_days", age).withColumn(
        "status", F.when(F.col("last_update").isNull(), "failed").when(age > stale_after_days, "partial").otherwise("success"))


def cluster_multiples(df: DataFrame, features: Sequence[str], k: int = 5, seed: int = 0) -> DataFrame:
    """Latest row per symbol, standardised, clustered and projected to two components."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    full = df.where(" and ".join(f"`{f}` is not null" for f in features))
    rest = [c for c in full.columns if c != "symbol"]
    last = full.groupBy("symbol").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), "year").alias("r")).select("symbol", "r.*")
    safe = last.select("symbol", *[F.col(f"`{f}`").alias(f"x{i}") for i, f in enumerate(features)])
    safe = cut(safe)  # the fit passes over it many times
    model = Pipeline(stages=[
        VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="v"),
        StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True),
        KMeans(featuresCol="z", predictionCol="cluster", k=k, seed=seed),
        PCA(inputCol="z", outputCol="p", k=2)]).fit(safe)
    out = model.transform(safe).withColumn("p", vector_to_array("p"))
    return out.select("symbol", "cluster", F.col("p")[0].alias("pca_1"), F.col("p")[1].alias("pca_2"))
