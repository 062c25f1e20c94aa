"""Registered queries against their SQL, and the contract of the entry module."""
import pytest

from pitval.plans import all_queries
from tests.oracle_check import compare, duck

FAST = ["j1_asof_price", "j2_asof_fallback", "j4_membership_asof", "j5_event_between", "j8_null_safe_period", "j12_nearest_contract",
        "w1_capped_weights", "w8_trailing_year", "w9_discrete_quarters", "w11_membership_spans", "w13_longest_drawdown", "g5_first_published",
        "p3_ebit_cascade", "p12_dcf", "f4_item_codes", "f9_price_and_greeks", "m1_run_metrics", "m15_eligible_signals", "s4_nested_facts",
        "s6_log_last_write", "flagship_peer_gap"]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, sf, con, name):
    ok, note = compare(all_queries()[name], spark, con, sf)
    assert ok, note


def test_entry_module(spark):
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[0] == "symbol"


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = all_queries()["s1_column_scan"].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    read = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "o_totalprice" in read and "o_orderpriority" not in read


def test_asof_plan_has_no_product_or_nested_loop(spark, sf):
    for name in ("j1_asof_price", "j4_membership_asof", "j5_event_between", "j12_nearest_contract"):
        plan = all_queries()[name].run(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner\n" not in plan and "Cross" not in plan
