"""Rules over groups, profiles of mixed JSON and counted writes."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyward.operators.group_rules import GroupRule, group_rule_violations
from tallyward.operators.json_profile import json_profile, nesting
from tallyward.sources import sinks

RULES = [
    GroupRule("key", ("a", "b")),
    GroupRule("other order", ("b", "a"), ("c",)),
    GroupRule("single", ("a",), ("b", "c")),
    GroupRule("swap", ("c",), ("a",)),
    GroupRule("odd name", ("x.y",)),
]


def brute(rows, rules, columns):
    out = {}
    for rule in rules:
        groups = defaultdict(list)
        for row in rows:
            cell = dict(zip(columns, row))
            groups[tuple(cell[c] for c in rule.by)].append(tuple(cell[c] for c in rule.decides))
        bad = [g for g in groups.values() if (len(set(g)) > 1 if rule.decides else len(g) > 1)]
        out[rule.name] = (len(groups), len(bad), sum(map(len, bad)))
    return out


def counted(df, rules=RULES):
    return {r.rule: (r.groups, r.violating_groups, r.violating_rows) for r in group_rule_violations(df, rules).collect()}


@pytest.mark.parametrize("size", [0, 1, 40, 600])
def test_rules_equal_brute_force(spark, size):
    rng = random.Random(size)
    columns = ["a", "b", "c", "x.y"]
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "", "p"]), rng.choice([None, 0.0, 1.5]), rng.randint(0, size)) for _ in range(size)]
    df = spark.createDataFrame(rows, "a int, b string, c double, `x.y` int")
    assert counted(df) == brute(rows, RULES, columns)


def test_a_null_differs_from_values_that_move_beside_it(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "x", None)], "a int, b string, c string")
    assert counted(df, [GroupRule("r", ("a",), ("b", "c"))]) == {"r": (1, 1, 2)}


def test_rules_share_one_scan_and_one_shuffle_by_key(spark, tmp_path):
    spark.range(100).selectExpr("id % 7 AS a", "id AS b", "id % 3 AS c", "id AS `x.y`").write.parquet(str(tmp_path / "t"))
    plan = group_rule_violations(spark.read.parquet(str(tmp_path / "t")), RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_a_set_carries_the_digests_of_its_own_rules(spark):
    rules = [GroupRule("k", ("a",)), GroupRule("x", ("a", "b"), ("c",)), GroupRule("y", ("b",), ("c",))]
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 1, 1), (2, 2, 1)], "a int, b int, c int")
    plan = group_rule_violations(df, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min(") == 2
    assert counted(df, rules) == {"k": (2, 2, 4), "x": (3, 1, 2), "y": (2, 1, 3)}


def test_rules_are_checked(spark):
    df = spark.range(1)
    for rules in ([], [GroupRule("n", ())], [GroupRule("n", ("id",)), GroupRule("n", ("id",), ("id",))]):
        with pytest.raises(ValueError):
            group_rule_violations(df, rules)


def walk(value, path, out):
    kinds = {dict: "object", list: "array", bool: "boolean", int: "integer", float: "number", str: "string", type(None): "null"}
    out[path, kinds[type(value)]] += 1
    if isinstance(value, dict):
        for k, v in value.items():
            walk(v, f"{path}.{k}", out)
    elif isinstance(value, list):
        for v in value:
            walk(v, path + "[*]", out)


def test_profile_equals_brute_force(spark):
    rng = random.Random(3)

    def made(depth):
        kind = rng.randint(0, 7 if depth else 5)
        if kind == 6:
            return {k: made(depth - 1) for k in rng.sample("abc", rng.randint(0, 3))}
        if kind == 7:
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([None, True, 7, 2.5, "text", '{"[\\'])

    values = [made(4) for _ in range(200)]
    want = Counter({("$", "malformed"): 2, ("$", "absent"): 1})
    for v in values:
        walk(v, "$", want)
    docs = [(json.dumps(v),) for v in values] + [("{",), ("",), (None,)]
    got = json_profile(spark.createDataFrame(docs, "`a.b` string"), "a.b").collect()
    assert {(r.path, r.type): r["values"] for r in got} == dict(want)
    kinds = defaultdict(set)
    for path, kind in want:
        kinds[path] |= {kind} - {"null", "malformed", "absent"}
    assert all(r.mixed == (len(kinds[r.path]) > 1) for r in got)


def test_profile_of_nothing_and_nesting(spark):
    assert json_profile(spark.createDataFrame([], "d string"), "d").count() == 0
    rows = spark.createDataFrame([('{"a[[[": [{"\\"{": 1}, []]}',), ("3",), ("",)], "d string")
    assert [r[0] for r in rows.select(nesting(F.col("d"))).collect()] == [3, 0, 0]


def test_writes_count_once(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 8)
    path = str(tmp_path / "t")
    assert sinks.write_observed(rows, path, total=F.sum("id")) == {"rows": 1000, "total": 499500}
    for expected, complete in ((None, True), (10, True), (11, False)):
        row = sinks.write_accounted(rows.limit(10), path, expected).first()
        assert (row.written_rows, row.stored_rows, row.complete) == (10, 10, complete)
    assert sinks.write_accounted(rows.limit(0), path).first().written_rows == 0
