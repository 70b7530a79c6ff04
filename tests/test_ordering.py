"""Positions, exact samples and disorder against brute force, hot keys included."""

import random

from pyspark.sql import functions as F

from tallyward.operators import integrity, ordering, reconcile


def test_dense_position_over_gaps_and_blocks(spark):
    block = 1 << ordering.BLOCK_BITS
    values = random.Random(1).sample(range(-5, block * block * 3), 400) + [block - 1, block, block * block]
    values = sorted(set(values))
    df = spark.createDataFrame([(v, v % 3 == 0) for v in values], "seq long, odd boolean")
    got = ordering.dense_positions(df, {"p": F.lit(True), "q": F.col("odd")}).collect()
    assert {r.seq: r.p for r in got} == {v: i for i, v in enumerate(values)}
    kept = [v for v in values if v % 3 == 0]
    assert {r.seq: r.q for r in got if r.q is not None} == {v: i for i, v in enumerate(kept)}


def test_sparse_and_absent_order_values(spark):
    values = [v << 30 for v in range(-500, 500)]
    df = spark.createDataFrame([(v,) for v in [*values, None, None, None]], "seq long")
    got = ordering.dense_position(df).collect()
    assert {r.seq: r.position for r in got if r.seq is not None} == {v: i for i, v in enumerate(values)}
    assert [r.position for r in got if r.seq is None] == [None] * 3
    assert reconcile.arrival_disorder(df.withColumn("v", -F.col("seq")), "v").first().out_of_order == 999


def test_small_groups_have_the_same_positions(spark):
    df = spark.range(60).select((F.col("id") * 7 % 60).alias("seq"), (F.col("id") % 3).alias("g"))
    wanted = {"p": F.lit(True), "q": F.col("seq") % 2 == 0}
    one, other = ordering.dense_positions(df, wanted, by=["g"]), ordering.small_group_positions(df, wanted, ["g"])
    assert sorted(one.collect()) == sorted(other.select(*one.columns).collect())


def test_dense_position_per_group(spark):
    df = spark.range(90).select(F.col("id").alias("seq"), (F.col("id") % 3).alias("g"))
    got = ordering.dense_position(df, by=["g"]).collect()
    assert all(r.position == r.seq // 3 for r in got)


def test_smallest_k_is_exact(spark):
    df = spark.range(1000).withColumnRenamed("id", "seq").cache()
    for k in (0, 1, 137, 999, 1000, 2000):
        expected = min(k, 1000)
        hit = ordering.smallest_k(df, lambda total, k=k: F.least(total, F.lit(k).cast("long")), "t")
        assert df.filter(hit).count() == expected


def test_disorder_matches_brute_force_with_a_hot_key(spark):
    rnd = random.Random(7)
    rows, last, want = [], {}, {}
    for seq in range(0, 200_000, 37):
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randint(0, 50)}"
        value = rnd.randint(0, 1000)
        rows.append((seq, key, value))
        want[key] = want.get(key, 0) + (key in last and last[key] > value)
        last[key] = value
    df = spark.createDataFrame(rows, "seq long, k string, v long")
    got = {r.k: r.out_of_order for r in reconcile.arrival_disorder(df, "v", "seq", ["k"]).collect()}
    assert got == want


def test_duplicates_of_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 40}", i % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, k string, version int")
    best = {}
    for seq, key, version in rows:
        best[key] = min(best.get(key, (0, 10**9)), (-version, seq))
    kept = integrity.dedupe_keep_first(df, ["k"], prefer=F.col("version")).collect()
    assert {r.k: r.seq for r in kept} == {k: s for k, (_, s) in best.items()}
    assert integrity.duplicate_rows(df, ["k"], prefer=F.col("version")).count() == len(rows) - len(best)


def test_positional_mismatch_counts_surplus_target_rows(spark):
    source = spark.createDataFrame([(0, "a"), (5, "b")], "seq long, event_time string")
    target = spark.createDataFrame([(1, "a"), (2, "c"), (9, "d")], "seq long, event_time string")
    got = reconcile.positional_mismatch_rate(source, target).first()
    assert (got.mismatches, got.source_rows, got.mismatch_rate) == (2, 2, 1.0)


def test_inversions_of_small_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "SMALL_GROUP_ROWS", 50)
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 2 else f"k{i % 38}", rnd.randint(0, 90)) for i in range(400)]
    rows += [(400, "tie", 5), (400, "tie", 1), (1, None, 9), (2, None, 1), (None, "k0", 1), (7, "k0", None)]
    got = reconcile.inversions(spark.createDataFrame(rows, "seq long, k string, v long"), "v", by=["k"]).collect()
    placed = [r for r in rows if None not in r]
    want = {k: 0 for _, k, _ in rows}
    for s, k, v in placed:
        want[k] += sum(k == x and s < t and v > w for t, x, w in placed)
    assert {r.k: r.inversions for r in got} == want


def test_rows_of_small_groups_are_shuffled_before_they_are_multiplied(spark):
    df = spark.range(100).selectExpr("id % 9 AS k", "id AS _order", "id * 7 % 31 AS _value")
    plan = reconcile._pairs_in_small_groups(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning")
