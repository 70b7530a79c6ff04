"""Fault injection invariants."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyward.operators import faults, generate
from tallyward.plans import scenarios


def _labelled(df, name):
    return df.filter(F.array_contains("faults", name)).count()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 400), rate=st.floats(0, 0.5))
def test_drop_and_lost_partition_the_rows(spark, n, rate):
    orders = generate.generate_orders(spark, n)
    kept, lost = faults.inject_missing(orders, rate), faults.missing_rows(orders, rate)
    assert kept.unionByName(lost).count() == n
    assert kept.join(lost, "seq").count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 300), rate=st.floats(0, 0.5))
def test_reordering_permutes_arrival_numbers(spark, n, rate):
    orders = generate.generate_orders(spark, n)
    moved = faults.inject_out_of_order(orders, rate)
    rows = moved.select("seq", "event_id", "faults").collect()
    assert sorted(r.seq for r in rows) == list(range(n))
    assert {r.event_id for r in rows} == {f"order-{i:06d}" for i in range(n)}
    for r in rows:
        assert bool(r.faults) == (r.event_id != f"order-{r.seq:06d}")


def test_copies_come_last_in_order(orders100):
    faulted = faults.inject_duplicates(orders100, 0.3)
    copies = faulted.filter("seq >= 100").orderBy("seq").collect()
    assert 0 < len(copies) == _labelled(faulted, "duplication")
    assert all(c.event_id == f"order-{c.seq - 100:06d}" for c in copies)
    assert faulted.select("seq").distinct().count() == faulted.count()


def test_corruption_and_drift_labels(orders100):
    corrupt = faults.inject_corruption(orders100, 0.3)
    assert corrupt.filter("checksum = 'invalid'").count() == _labelled(corrupt, "corruption") > 0
    first = corrupt.filter("checksum = 'invalid'").join(
        orders100.select("seq", F.col("amount").alias("before")), "seq"
    )
    assert first.filter("cast(amount as decimal(18,2)) <> cast(before as decimal(18,2)) * 10 + 1").count() == 0
    drift = faults.inject_schema_drift(orders100, 0.3)
    assert drift.filter("amount = 'N/A'").count() == _labelled(drift, "schema_drift") > 0


def test_corrupting_drifted_rows_keeps_the_text(orders100):
    both = faults.inject_corruption(faults.inject_schema_drift(orders100, 1.0), 1.0)
    assert both.filter("amount = 'N/A' and checksum = 'invalid'").count() == 100


def test_exact_faults(spark):
    records = generate.generate_ab(spark, 100)
    assert sorted(r.id for r in faults.inject_tail_loss(records).collect()) == list(range(90))
    assert faults.inject_tail_loss(records, 0.0).count() == 100
    copied = faults.inject_exact_duplicates(records)
    assert copied.count() == 110 and copied.distinct().count() == 100
    assert faults.inject_negative_id(records).filter("id = -1").count() == 10
    changed = faults.inject_exact_corruption(records, fields=["a"]).exceptAll(records)
    assert changed.count() == 10


def test_exact_corruption_by_type(spark):
    rows = spark.createDataFrame([(i, f"n{i}", i * 1.5) for i in range(20)], "id long, name string, x double")
    out = {r.id: r for r in faults.inject_exact_corruption(rows, 1.0, ["name", "x"]).collect()}
    assert all(r.name in (f"n{i}", f"n{i}_corrupt") and r.x == i * 1.5 for i, r in out.items())
    assert any(r.name.endswith("_corrupt") for r in out.values())


def test_generated_orders(spark):
    rows = generate.generate_orders(spark, 50).orderBy("seq").collect()
    assert rows[3].event_id == "order-000003" and rows[3].event_time == "2024-01-01T00:00:30"
    assert all(10.0 <= float(r.amount) <= 500.0 and "cust-001" <= r.customer_id <= "cust-100" for r in rows)
    assert {r.status for r in rows} == {"created", "paid", "shipped"}
    ab = generate.generate_ab(spark, 50).collect()
    assert all(1 <= r.a <= 100 and 1 <= r.b <= 100 for r in ab)


def test_one_plan_equals_one_by_one(orders100):
    together = scenarios.injected(orders100, list(scenarios.SCENARIOS))
    for name in scenarios.SCENARIOS:
        mine = together.filter(F.col("scenario") == name).drop("scenario")
        alone = scenarios.inject(orders100, name)
        assert mine.exceptAll(alone).count() == 0 and alone.exceptAll(mine).count() == 0, name


def test_custom_scenario_knows_its_losses(orders100):
    scenarios.register_scenario("no_paid", lambda e: e.filter("status <> 'paid'"))
    try:
        lost = scenarios.lost_rows(orders100, ["no_paid"])
        assert lost.count() == orders100.filter("status = 'paid'").count()
    finally:
        del scenarios.SCENARIOS["no_paid"]


def test_a_swap_rate_over_half_is_refused(orders100):
    import pytest

    from tallyward.operators import faults

    with pytest.raises(ValueError):
        faults.inject_out_of_order(orders100, 0.9)
