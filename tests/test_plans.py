"""What the plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from tallyward.catalog.queries import all_queries
from tallyward.operators import checks, faults, ordering, reconcile
from tallyward.plans import proposed
from tallyward.plans.views import order_events, table

SF = "/root/testdata/sf0.001"
AS_OF = "2001-08-02T00:00:00"


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def events(spark):
    return order_events(table(spark, SF, "orders"))



def _input_of_single_partition(plan):
    """The node right below each SinglePartition exchange."""
    lines = plan.split("== Physical Plan ==")[1].splitlines()
    return [lines[i + 1] for i, line in enumerate(lines) if "Exchange SinglePartition" in line]


@pytest.mark.parametrize("build", [
    lambda e: ordering.dense_position(e),
    lambda e: reconcile.positional_mismatch_rate(e, e.filter("seq % 7 <> 0")),
    lambda e: reconcile.arrival_disorder(e, key=["customer_id"]),
    lambda e: e.filter(ordering.smallest_k(e, lambda n: F.floor(n / 10), "t")),
    lambda e: proposed.metrics(e, AS_OF),
    lambda e: faults.inject_out_of_order(e, 0.2),
])
def test_only_aggregates_meet_in_one_task(events, build):
    below = _input_of_single_partition(_plan(build(events)))
    assert all("HashAggregate" in n or "SortAggregate" in n for n in below), below


def test_no_python_and_no_cross_joins(spark):
    for name in ("proposed_mixed", "scores_true", "fault_exact_corrupt", "microbatch_metrics", "kpi_stats"):
        plan = _plan(all_queries()[name](spark, SF))
        for word in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in plan, (name, word)


def test_scans_read_only_what_is_needed(spark, events):
    plan = _plan(checks.null_profile(events.select("seq", "status"), ["status"]))
    assert re.findall(r"ReadSchema: (\S+)", plan) == ["struct<o_orderstatus:string>"]
    plan = _plan(all_queries()["consistency_orders_lineitem"](spark, SF))
    assert sorted(re.findall(r"ReadSchema: (\S+)", plan)) == [
        "struct<l_orderkey:bigint>", "struct<o_orderkey:bigint>",
    ]


def test_filters_reach_the_scan(events):
    plan = _plan(events.filter("seq > 100").select("event_id"))
    assert "GreaterThan(o_orderkey,100)" in plan


def test_reconciliation_is_one_keyed_shuffle(events):
    plan = _plan(reconcile.reconcile_keys(events, events.filter("seq > 5"), ["event_id"]))
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1
    assert "Join" not in plan.split("== Physical Plan ==")[1]
