"""Rules over groups of rows: keys and functional dependencies, all counted in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GroupRule:
    """Rows equal in ``by`` are one row (``decides`` is empty: a key), or agree in the columns of ``decides``."""

    name: str
    by: tuple[str, ...]
    decides: tuple[str, ...] = ()


def group_rule_violations(df: DataFrame, rules: Sequence[GroupRule]) -> DataFrame:
    """Per rule: rule, groups, violating_groups and violating_rows (all rows of these groups).

    Rules with the same columns ``by`` share a set, and all sets share one scan and one shuffle. Groups are
    aggregated before that shuffle, so a group that holds a third of the rows costs one row per task. Agreement is that of
    128-bit digests, the least and the greatest of a group being the same. A null is a value like any other. A rule over
    an empty table has no groups and no violations.
    """
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("rules need different names")
    if not rules or any(not r.by for r in rules):
        raise ValueError("a rule needs columns to group by")
    sets = list(dict.fromkeys(tuple(sorted(set(r.by))) for r in rules))
    columns = sorted({c for s in sets for c in s})
    group = {c: f"_by{i}" for i, c in enumerate(columns)}
    # The rules of a set take its slots in turn, so a row of a set carries the digests of its own rules and no others.
    slots: dict[str, int] = {}
    deciding: dict[tuple[str, ...], list[GroupRule]] = {s: [] for s in sets}
    for rule in rules:
        if rule.decides:
            mine = deciding[tuple(sorted(set(rule.by)))]
            slots[rule.name] = len(mine)
            mine.append(rule)
    digests = [(k, j) for k in range(max(map(len, deciding.values()))) for j in (0, 1)]

    def digest(rule: GroupRule, j: int) -> Column:
        # xxhash64 skips nulls, so whether a value is there is hashed as well.
        parts = [x for c in rule.decides for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
        return F.xxhash64(F.lit(f"group rule {j}"), *parts)

    def member(i: int, s: tuple[str, ...]) -> Column:
        """A row as a member of the set: columns and slots that the set does not have are null."""
        nothing = F.lit(None).cast("bigint")
        keys = [(F.col(f"`{c}`") if c in s else F.lit(None).cast(df.schema[c].dataType)).alias(n) for c, n in group.items()]
        held = [(digest(deciding[s][k], j) if k < len(deciding[s]) else nothing).alias(f"_d{k}_{j}") for k, j in digests]
        return F.struct(F.lit(i).alias("_set"), *keys, *held)

    members = df.select(F.inline(F.array(*[member(i, s) for i, s in enumerate(sets)])))
    bounds = [f(f"_d{k}_{j}").alias(f"_d{k}_{j}_{f.__name__}") for k, j in digests for f in (F.min, F.max)]
    grouped = members.groupBy("_set", *group.values()).agg(F.count("*").alias("_rows"), *bounds)

    def broken(rule: GroupRule) -> Column:
        if not rule.decides:
            return F.col("_rows") > 1
        names = [f"_d{slots[rule.name]}_{j}" for j in (0, 1)]
        return reduce(Column.__or__, [F.col(f"{n}_min") != F.col(f"{n}_max") for n in names])

    totals = []
    for i, rule in enumerate(rules):
        mine = F.col("_set") == sets.index(tuple(sorted(set(rule.by))))
        totals += [
            F.count_if(mine).alias(f"groups{i}"),
            F.count_if(mine & broken(rule)).alias(f"bad{i}"),
            F.coalesce(F.sum(F.when(mine & broken(rule), F.col("_rows"))), F.lit(0)).alias(f"rows{i}"),
        ]
    lines = [
        F.struct(
            F.lit(rule.name).alias("rule"),
            F.col(f"groups{i}").alias("groups"),
            F.col(f"bad{i}").alias("violating_groups"),
            F.col(f"rows{i}").alias("violating_rows"),
        )
        for i, rule in enumerate(rules)
    ]
    return grouped.agg(*totals).select(F.inline(F.array(*lines)))
