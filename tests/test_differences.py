"""Finding what differs: digest trees, key sketches, missing intervals, inversions; all against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallyward.operators import digest_tree, key_sketch, reconcile


def _brute_differences(source, target):
    def by_key(rows):
        out = {}
        for k, *rest in rows:
            out.setdefault(k, []).append(tuple(rest))
        return {k: sorted(v, key=str) for k, v in out.items()}

    s, t = by_key(source), by_key(target)
    status = lambda k: "missing" if k not in t else "unexpected" if k not in s else "changed"
    return sorted(
        ((k, status(k), len(s.get(k, [])), len(t.get(k, []))) for k in {*s, *t} if s.get(k) != t.get(k)), key=str
    )


@pytest.mark.parametrize("changed", [0, 3, 200])
def test_digest_tree(spark, changed):
    rng = random.Random(changed)
    source = [(i, f"v{i}", i % 7 or None) for i in range(400)] + [(5, "v5", 5), (6, "v6", 6), (None, None, None)]
    target = list(source)
    for _ in range(changed):
        k = rng.randrange(len(target))
        target[k] = rng.choice([(target[k][0], "other", 1), (target[k][0], None, target[k][2]), (1000 + k, "new", 0)])
    target += target[:changed]
    schema = "k long, a string, b long"
    s, t = (spark.createDataFrame(rows, schema).repartition(4) for rows in (source, target))
    got = digest_tree.differing_keys(s, t, ["k"], ["a", "b"]).collect()
    assert sorted((tuple(r) for r in got), key=str) == _brute_differences(source, target)


def test_rows_of_equal_buckets_are_left_out(spark):
    source = spark.range(20_000).select("id", (F.col("id") * 3).alias("v"))
    target = source.withColumn("v", F.when(F.col("id").isin(77, 4321), -1).otherwise(F.col("v")))
    sides = digest_tree._sides(source, target, ["id"], ["v"])
    left = digest_tree.rows_of_unequal_buckets(sides).select("_key.id").distinct().collect()
    assert {77, 4321} <= {r.id for r in left} and len(left) < 10
    assert digest_tree.rows_of_unequal_buckets(digest_tree._sides(source, source, ["id"], ["v"])).count() == 0


def _sets(spark, source, target):
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    return frame(source), frame(target)


@pytest.mark.parametrize("differences", [0, 1, 40, 900])
def test_key_sketch_equals_all_ids(spark, differences):
    """Few differences are peeled off a small sketch, many are not and are compared in full; ids may repeat."""
    rng = random.Random(differences)
    source = [rng.randrange(-(1 << 60), 1 << 60) for _ in range(3000)]
    target = source[differences:] + [rng.randrange(1 << 62) for _ in range(differences)] + source[-20:] + [None, None]
    s, t = _sets(spark, source + source[:10] + [None], target)
    cells = 3 * 256
    peeled = key_sketch.peeled([tuple(r) for r in key_sketch.difference(s, t, "id", cells).collect()], cells)
    assert (peeled is None) == (differences == 900)
    got = sorted(tuple(r) for r in key_sketch.differing_ids(s, t, "id", cells).collect())
    have, want = set(target) - {None}, set(source)
    assert got == sorted([(i, "missing") for i in want - have] + [(i, "unexpected") for i in have - want])
    counts = reconcile.reconcile_keys(s.filter("id IS NOT NULL"), t.filter("id IS NOT NULL"), ["id"]).first()
    assert (counts.missing, counts.unexpected) == tuple(sum(x[1] == side for x in got) for side in ("missing", "unexpected"))


def test_sketches_of_parts_add_up(spark):
    whole = spark.range(500).withColumnRenamed("id", "k")
    parts = key_sketch.sketch(whole.filter("k < 200"), "k").unionByName(key_sketch.sketch(whole.filter("k >= 200"), "k"))
    summed = parts.groupBy("cell").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "key_sum", "check_sum")])
    one = key_sketch.sketch(whole, "k").selectExpr("cell", "n", "bigint(key_sum) key_sum", "bigint(check_sum) check_sum")
    assert sorted(summed.collect()) == sorted(one.collect())


@pytest.mark.parametrize("n, ids", [
    (0, []), (5, []), (5, [0, 1, 2, 3, 4]), (10, [3, 3, 4, 9, -2, 12, None]), (1 << 40, [0, 1 << 33, (1 << 33) + 2, (1 << 40) - 1]),
    (70_000, [i for i in range(70_000) if i % 1000 and not 20_000 < i < 50_000]),
    (1 << 62, [5, (1 << 52) + 7]),
])
def test_missing_intervals(spark, n, ids):
    frame = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    got = sorted(tuple(r) for r in reconcile.missing_intervals(frame, F.lit(n).cast("long")).collect())
    there = sorted({-1, n, *(i for i in ids if i is not None and 0 <= i < n)})
    assert got == [(a + 1, b - 1, b - a - 1) for a, b in zip(there, there[1:]) if b - a > 1]
    if n <= 70_000:
        listed = sorted(r.id for r in reconcile.missing_ids(frame, F.lit(n).cast("long")).collect())
        assert listed == [i for a, b, _ in got for i in range(a, b + 1)]


def test_intervals_are_not_written_out(spark):
    frame = spark.range(3)
    row = reconcile.missing_intervals(frame, F.lit(1 << 60).cast("long")).first()
    assert tuple(row) == (3, (1 << 60) - 1, (1 << 60) - 3)
    assert "Range (0, 1152921504606846976" not in reconcile.missing_intervals(frame, F.lit(1 << 60).cast("long"))._jdf.queryExecution().toString()


def test_inversions(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([i, None]) if i % 50 == 0 else i, rng.choice([rng.randrange(40), rng.randrange(-(1 << 50), 1 << 50), None]))
            for g in (1, 2, None) for i in range(150)]
    rows += [(3, i, i) for i in range(100)] + [(4, i, -i) for i in range(100)] + [(5, 1, None)]
    frame = spark.createDataFrame(rows, "g long, seq long, v long").repartition(5)

    def brute(some):
        some = sorted((s, v) for s, v in some if s is not None and v is not None)
        return len(some), sum(a[1] > b[1] for i, a in enumerate(some) for b in some[i + 1 :])

    got = {r.g: (r.rows, r.inversions) for r in reconcile.inversions(frame, "v", by=["g"]).collect()}
    assert got == {g: brute([r[1:] for r in rows if r[0] == g]) for g in (1, 2, 3, 4, 5, None) if g is not None} | {None: got[None]}
    some = [(i * 7, v) for i, v in enumerate([*range(300, 0, -1), *range(50)])]
    assert tuple(reconcile.inversions(spark.createDataFrame(some, "seq long, v long"), "v").first()) == brute(some)
    assert tuple(reconcile.inversions(frame.filter("false"), "v").first()) == (0, 0)


def test_no_window_over_all_rows(spark):
    for df in (reconcile.inversions(spark.range(9).withColumn("v", -F.col("id")), "v", "id"), reconcile.missing_intervals(spark.range(9), F.lit(20))):
        plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].splitlines()
        below = [plan[i + 1] for i, line in enumerate(plan) if "Exchange SinglePartition" in line]
        assert all("Aggregate" in x or "Window" in x or "Project" in x for x in below)
