"""Time the headline queries; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pitval.plans import all_queries  # noqa: E402

HEADLINE = (
    "j5_event_between", "j2_asof_fallback", "j4_membership_asof", "flagship_peer_gap", "j12_nearest_contract", "j17_dense_panel",
    "w1_capped_weights", "w7_realized_vol", "w11_membership_spans", "w13_drawdowns", "w15_side_curves", "g1_sector_statistics",
    "g2_cohort_medians", "g5_first_published", "p12_dcf", "f9_price_and_greeks", "f10_implied_vol_round_trip", "f11_payoff_moments",
    "f12_kelly_strike", "f16_order_fees", "m1_run_metrics", "m2_trade_metrics", "m7_pnl_by_exit_reason", "m15_eligible_signals",
    "s4_nested_facts", "d1_upsert_prices", "t2_latest_signal",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    todo = all_queries()
    picked = sys.argv[1:] or list(HEADLINE)
    spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start the engine
    took = {}
    for name in picked:
        start = time.time()
        todo[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
