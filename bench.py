"""Times headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores), BENCH_RUNS (runs per
query, the median counts). Every query runs to the end into Spark's ``noop`` sink. ``overhead_ratio`` is the checked flow's
time over that of the minimal one, both over the same scenario. ``kpi_stats`` reads stored results; ``first_run`` tells
what its first run took, in which they are computed and written.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyward.catalog.queries import NAMES, all_queries  # noqa: E402
from tallyward.plans import baseline, scenarios  # noqa: E402
from tallyward.plans.views import order_events, spread, table  # noqa: E402
from tallyward.session import get_session  # noqa: E402

HEADLINE = tuple(os.environ["BENCH_ONLY"].split(",")) if os.environ.get("BENCH_ONLY") else (
    "baseline_batch",
    "proposed_clean",
    "proposed_duplicated",
    "proposed_dropped",
    "proposed_corrupted",
    "proposed_schema_drift",
    "proposed_out_of_order",
    "proposed_mixed",
    "duplicate_count",
    "dedupe_keep_first",
    "reconcile_ids",
    "positional_mismatch_rate",
    "arrival_disorder",
    "real_world_lineitem_keys",
    "real_world_doc_text",
    "consistency_orders_lineitem",
    "scenario_results",
    "scores_true",
    "stage_check_report",
    "kpi_stats",
)

def minimal(scenario: str):
    return lambda spark, sf: baseline.metrics(
        baseline.transform(scenarios.inject(order_events(spread(table(spark, sf, "orders"))), scenario))
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = all_queries()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in NAMES:
        queries[f"minimal_{name}"] = minimal(name)
    run("proposed_mixed")
    checked_names = [n for n in HEADLINE if n.startswith("proposed_")]
    wanted = [*HEADLINE, *(n.replace("proposed_", "minimal_") for n in checked_names)]
    times = {name: [run(name) for _ in range(runs)] for name in wanted}
    seconds = {name: statistics.median(t) for name, t in times.items()}
    ratios = {
        n.removeprefix("proposed_"): round(seconds[n] / seconds[n.replace("proposed_", "minimal_")], 2)
        for n in checked_names
    }
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds[n] for n in HEADLINE), 3),
                "unit": "sec",
                "queries": {n: round(s, 3) for n, s in seconds.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "orders": orders,
                "overhead_ratio": ratios,
                "first_run": {n: round(times[n][0], 3) for n in HEADLINE if n == "kpi_stats"},
                "rows_per_second": {n: round(orders / seconds[n]) for n in wanted if n.startswith(("minimal", "proposed"))},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
