"""Option pricing identities, selection, strike choice and fees."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitval.functions import normal
from pitval.operators import options as op


def chain(spark, rows, cols="option_type string, spot double, strike double, t double, iv double, r double, q double"):
    return spark.createDataFrame(rows, cols)


def test_normal_distribution(spark):
    z = [x / 7 for x in range(-60, 61)] + [-40.0, 40.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in z], "z double").select(normal.cdf(F.col("z")).alias("p")).collect()]
    want = [0.5 * math.erfc(-x / math.sqrt(2)) for x in z]
    assert got == pytest.approx(want, abs=2e-15)
    assert normal.cdf_array(np.array(z)) == pytest.approx(want, abs=2e-15)


def test_parity_and_greek_bounds(spark):
    rows = [(k, 100.0, float(x), t, 0.3, 0.04, 0.02) for k in ("CALL", "PUT") for x in (70, 100, 130) for t in (0.1, 1.0, 2.0)]
    out = op.price_and_greeks(chain(spark, rows)).collect()
    by = {(r.option_type, r.strike, r.t): r for r in out}
    for (kind, k, t), c in by.items():
        if kind == "CALL":
            p = by[("PUT", k, t)]
            assert c.price - p.price == pytest.approx(100 * math.exp(-0.02 * t) - k * math.exp(-0.04 * t), abs=1e-10)
            assert 0 <= c.delta <= 1 and -1 <= p.delta <= 0 and c.gamma == pytest.approx(p.gamma) and c.vega > 0


def test_degenerate_prices_are_intrinsic(spark):
    rows = [("CALL", 100.0, 90.0, 0.0, 0.3, 0.04, 0.0), ("PUT", 100.0, 90.0, 1.0, 0.0, 0.04, 0.0), ("PUT", 80.0, 90.0, 0.0, 0.3, 0.04, 0.0)]
    out = op.price_and_greeks(chain(spark, rows)).collect()
    assert [(r.price, r.delta, r.gamma, r.theta) for r in out] == [(10.0, 1.0, 0, 0), (0.0, 0.0, 0, 0), (10.0, -1.0, 0, 0)]


def test_implied_volatility_inverts_and_rejects(spark):
    rows = [("CALL", 100.0, 110.0, 1.0, 0.37, 0.04, 0.0), ("PUT", 100.0, 110.0, 0.5, 0.21, 0.04, 0.0)]
    priced = op.price_and_greeks(chain(spark, rows)).withColumn("mid", F.col("price"))
    assert [r.implied_vol for r in op.implied_vol(priced).collect()] == pytest.approx([0.37, 0.21], abs=1e-9)
    bad = [("CALL", 100.0, 80.0, 1.0, 10.0), ("CALL", 100.0, 80.0, 1.0, 150.0), ("CALL", 100.0, 80.0, 0.0, 25.0), ("PUT", 100.0, 80.0, 1.0, None)]
    df = chain(spark, bad, "option_type string, spot double, strike double, t double, mid double")
    assert [r.implied_vol for r in op.implied_vol(df).collect()] == [None] * 4


def test_moments_against_simulation(spark):
    rows = [(kind, 100.0, 105.0, 0.08, 0.35, 1.5, 12.0) for kind in ("CALL", "PUT")]
    out = op.payoff_moments(chain(spark, rows, "option_type string, spot double, strike double, mu double, sigma double, t double, premium double")).collect()
    z = np.random.default_rng(11).standard_normal(2_000_000)
    end = 100 * np.exp((0.08 - 0.35 ** 2 / 2) * 1.5 + 0.35 * math.sqrt(1.5) * z)
    for r in out:
        pay = np.maximum(end - 105, 0) if r.option_type == "CALL" else np.maximum(105 - end, 0)
        assert r.expected_payoff == pytest.approx(pay.mean(), rel=0.01)
        assert r.std_payoff == pytest.approx(pay.std(), rel=0.01)
        assert r.downside_semideviation == pytest.approx(math.sqrt((np.maximum(12 - pay, 0) ** 2).mean()), rel=0.01)
        assert r.probability_of_profit == pytest.approx((pay > 12).mean(), abs=0.002)


def test_drift_at_the_rate_gives_no_edge(spark):
    rows = [(k, 100.0, x, 0.04, 0.3, 1.0, 0.04, 0.0) for k in ("CALL", "PUT") for x in (80.0, 100.0, 125.0)]
    df = chain(spark, rows, "option_type string, spot double, strike double, mu double, iv double, t double, r double, q double")
    df = op.price_and_greeks(df).withColumns({"premium": F.col("price"), "sigma": F.col("iv")})
    for r in op.payoff_moments(df).collect():
        assert r.expected_payoff * math.exp(-0.04) == pytest.approx(r.price, abs=1e-10)


def test_kelly_matches_simulated_growth(spark):
    df = chain(spark, [("CALL", 100.0, 110.0, 0.15, 0.3, 1.0, 8.0)],
               "option_type string, spot double, strike double, mu double, sigma double, t double, premium double")
    r = op.add_growth(df).first()
    z = np.random.default_rng(5).standard_normal(1_000_000)
    end = 100 * np.exp((0.15 - 0.045) + 0.3 * z)
    gain = np.maximum(end - 110, 0) / 8 - 1
    growth = lambda f: np.log1p(f * gain).mean()
    grid = np.linspace(0.0, 0.6, 121)
    best = grid[np.argmax([growth(f) for f in grid])]
    assert r.kelly_fraction == pytest.approx(best, abs=0.02)
    assert r.log_growth == pytest.approx(growth(r.kelly_fraction), abs=1e-3)


def test_best_strike_counts_and_refuses(spark):
    base = chain(spark, [("good", "CALL", 100.0, 0.15, 0.3, 1.0), ("bad", "CALL", 100.0, -0.2, 0.3, 1.0)],
                 "id string, option_type string, spot double, mu double, sigma double, t double")
    grid = op.strike_grid(base).withColumns({"r": F.lit(0.04), "q": F.lit(0.0)})
    df = op.price_and_greeks(grid, vol="sigma").withColumnRenamed("price", "premium")
    out = {r.id: r for r in op.best_strike(df, ["id"]).collect()}
    assert out["bad"].strike is None and out["bad"].n_negative_edge == 25
    assert out["good"].n_candidates == 25 and 0 < out["good"].kelly_fraction < 1 and out["good"].edge > 0
    with pytest.raises(ValueError):
        op.best_strike(df, ["id"], "sortino")


def snapshots(spark):
    rows = [("A", "CALL", "2024-01-10", 95.0, 700, 1.0), ("A", "CALL", "2024-01-10", 95.0, 100, 2.0), ("A", "CALL", "2024-01-10", 105.0, 730, 3.0),
            ("A", "CALL", "2024-02-10", 100.0, 730, 4.0)]
    df = spark.createDataFrame(rows, "symbol string, option_type string, snapshot_date string, strike double, tenor_days int, mid double")
    return df.withColumn("snapshot_date", F.to_date("snapshot_date")).withColumn("moneyness_pct", F.col("strike") - 100)


def ask(spark, day, strike, kind="CALL"):
    return spark.createDataFrame([("A", kind, dt.date.fromisoformat(day), strike)], "symbol string, option_type string, as_of date, target_strike double")


@pytest.mark.parametrize("day,strike,kind,want", [
    ("2024-01-12", 97.0, "CALL", (95.0, 1.0)), ("2024-01-12", 104.0, "CALL", (105.0, 3.0)), ("2024-01-12", 200.0, "CALL", (105.0, 3.0)),
    ("2024-01-12", None, "CALL", (105.0, 3.0)), ("2024-02-09", 97.0, "CALL", (None, None)), ("2024-01-09", 97.0, "CALL", (None, None)),
    ("2024-02-10", 97.0, "CALL", (100.0, 4.0)), ("2024-01-12", 97.0, "PUT", (None, None))])
def test_nearest_contract_never_looks_ahead(spark, day, strike, kind, want):
    r = op.nearest_contract(ask(spark, day, strike, kind), snapshots(spark), ["mid"]).first()
    assert (r.strike, r.mid) == want


def test_quoted_strikes_keep_one_tenor(spark):
    assert op.quoted_strikes(ask(spark, "2024-01-12", None), snapshots(spark)).first().strikes == [105.0]


def test_contracts_match_within_tolerance(spark):
    a = spark.createDataFrame([("e", 100.0, None, None), ("e", 101.0, 1.0, 0.2)], "k string, strike double, bid double, iv double")
    b = spark.createDataFrame([("e", 100.0000005, 5.0, 0.3), ("e", 101.00001, 9.0, 0.9)], "k string, strike double, bid double, iv double")
    got = {r.strike: (r.bid, r.iv, r.iv_source) for r in op.match_contracts(a, b, ["k"], ["bid", "iv"]).collect()}
    assert got == {100.0: (5.0, 0.3, "secondary"), 101.0: (1.0, 0.2, "primary")}


def test_fees_follow_volume_premium_and_side(spark):
    rows = [("r", "2024-01-02", 1, "buy", 5.0, 0.03), ("r", "2024-01-03", 2, "sell", 1.0, 2.0), ("r", "2024-01-04", 3, "buy", 20000.0, 2.0),
            ("r", "2024-01-05", 4, "buy", 10.0, 2.0), ("r", "2024-02-01", 5, "buy", 10.0, 0.07)]
    df = spark.createDataFrame(rows, "run_id string, date string, n int, side string, contracts double, price double")
    df = df.withColumns({"date": F.to_date("date"), "multiplier": F.lit(100.0)})
    out = {r.n: r for r in op.order_fees(df, ["run_id"], ["date", "n"]).collect()}
    per = 0.02295 + 0.0003 + 0.025
    assert [out[i].commission_rate for i in range(1, 6)] == [0.25, 0.65, 0.65, 0.5, 0.5]
    assert out[1].fees == pytest.approx(1.25 + 5 * per)
    assert out[2].fees == pytest.approx(1.0 + per + 0.00329 + 200 * 0.0000206)
    assert out[4].monthly_contracts == 20006.0 and out[5].monthly_contracts == 0.0


def test_orders_alternate_after_sells(spark):
    rows = [("CALL", 5.0, "a"), ("CALL", 9.0, "b"), ("PUT", 1.0, "c"), (None, 4.0, "d"), ("PUT", 0.0, "e"), ("CALL", 7.0, "f")]
    df = spark.createDataFrame([("r", *x) for x in rows], "run_id string, option_type string, size double, symbol string")
    out = op.interleaved(df, ["run_id"], "size", ["symbol"]).orderBy("position").collect()
    assert [r.symbol for r in out] == ["e", "b", "c", "f", "a", "d"]


def test_one_leg_with_very_many_strikes(spark):
    """All strikes of one leg: neither the next strikes nor the rungs need them in one place."""
    rng = np.random.default_rng(3)
    strikes = np.unique(rng.integers(1, 200_000, 20_000)) / 8
    day = dt.date(2024, 1, 5)
    rows = [("A", "CALL", day, float(k), t, 1.0, float(k)) for k in strikes for t in (700, 900)]
    book = spark.createDataFrame(rows, "symbol string, option_type string, snapshot_date date, strike double, tenor_days int, moneyness_pct double, mid double")
    wishes = [float(x) for x in rng.uniform(0, 26_000, 300)] + [float(strikes[0]), float(strikes[-1]), -1.0, 1e9]
    asked = spark.createDataFrame([(i, "A", "CALL", day, w) for i, w in enumerate(wishes)] + [(-1, "B", "CALL", day, 3.0)],
                                  "id int, symbol string, option_type string, as_of date, target_strike double")
    got = {r.id: r.strike for r in op.nearest_contract(asked, book, ["mid"]).collect()}
    assert got.pop(-1) is None
    assert got == {i: float(min(strikes, key=lambda k: (abs(k - w), k))) for i, w in enumerate(wishes)}
    rungs = op.listed_strikes(asked.where("id in (0, -1)"), book).collect()
    assert [r.strike for r in sorted(rungs, key=lambda r: r.rung)] == strikes.tolist() and {r.rung for r in rungs} == set(range(1, len(strikes) + 1))


@pytest.mark.parametrize("criterion", ["kelly", "sharpe"])
def test_the_premium_column_is_an_argument(spark, criterion):
    base = chain(spark, [("CALL", 100.0, 0.08, 0.3, 1.0, 0.04, 0.0)], "option_type string, spot double, mu double, sigma double, t double, r double, q double")
    priced = op.price_and_greeks(op.strike_grid(base), vol="sigma").withColumn("ask", F.col("price") * 1.02).withColumn("id", F.lit(1))
    asked = op.best_strike(priced, ["id"], criterion, premium="ask").first()
    same = op.best_strike(priced.withColumn("premium", F.col("ask")), ["id"], criterion).first()
    model = op.best_strike(priced.withColumn("premium", F.col("price")), ["id"], criterion).first()
    assert asked == same and asked.premium is not None and asked.score < model.score


def test_stakes_settle_in_few_passes_where_halving_ends():
    rng = np.random.default_rng(5)
    weight = rng.random((400, 64)) / 64
    lost = rng.uniform(1e-6, 0.9, 400)
    gain = rng.exponential(10.0 ** rng.uniform(-1, 3, (400, 1)), (400, 64)) - rng.random((400, 64))
    lost[:20] = 0.0

    def slope(f):
        return (weight * gain / (1 + f[:, None] * gain)).sum(axis=1) - lost / (1 - f)

    inside = (slope(np.zeros(400)) > 0) & (slope(np.full(400, op.MOST_STAKE)) <= 0)
    weight, gain, lost = weight[inside], gain[inside], lost[inside]
    a, b = np.zeros(len(lost)), np.full(len(lost), op.MOST_STAKE)
    for _ in range(60):
        m = (a + b) / 2
        up = slope(m) > 0
        a, b = np.where(up, m, a), np.where(up, b, m)
    stake, passes = op.log_optimal(weight, gain, lost)
    assert len(lost) > 100 and np.abs(stake - a).max() < 1e-11 and passes <= 20
    # a row does not depend on the rows beside it
    assert all(op.log_optimal(weight[i:i + 1], gain[i:i + 1], lost[i:i + 1])[0][0] == pytest.approx(stake[i], abs=1e-12) for i in range(20))
