"""Checksums, duplicates, assertions and rules.

Every duplicate operator aggregates per key before it shuffles, so a key that holds a
third of the table costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions import digests


# --- Checksums --------------------------------------------------------------


def row_checksums(df: DataFrame, columns: Sequence[str] | None = None, into: str = "row_checksum") -> DataFrame:
    return df.withColumn(into, digests.row_digest(columns or df.columns))


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Order-insensitive table digest: row count and sum of 32-bit row digests.

    A sum, not an exclusive or, so that two copies of a row do not cancel out.
    """
    names = list(columns or df.columns)
    word = digests.word32(digests.row_digest(names))
    return df.groupBy(*by).agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(word.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("fingerprint"),
    )


def checksum_report(annotated: DataFrame) -> DataFrame:
    """Mismatching rows and the zero-or-one flag over the rows that reach storage."""
    bad = F.count_if((F.col("outcome") == "stored") & ~F.col("checksum_ok"))
    return annotated.agg(
        F.count("*").alias("rows"), bad.alias("mismatch_rows"), (bad > 0).cast("int").alias("checksum_mismatch")
    )


# --- Duplicates -------------------------------------------------------------


def key_counts(df: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, *key).agg(F.count("*").alias("copies"))


def duplicate_summary(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows beyond the first per key, repeated keys, and whether all keys are unique.

    Null is a key like any other.
    """
    return key_counts(df, key).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("surplus_rows"),
        F.count_if(F.col("copies") > 1).alias("repeated_keys"),
        (F.count_if(F.col("copies") > 1) == 0).alias("unique"),
    )


def content_key(text: Column) -> list[Column]:
    """Digest and length standing in for long text as a grouping key.

    Equal texts always agree; grouping moves some forty bytes per row, not the text.
    """
    return [F.sha2(text, 256).alias("digest"), F.length(text).alias("length")]


def _ranked(df: DataFrame, key: Sequence[str], seq: str, prefer: Column | None) -> DataFrame:
    """Rows with their place among those of their key: highest ``prefer``, first to arrive, then row digest.

    Rows without a preference, and then without an arrival number, come last. Only equal rows have equal places.
    """
    order = [F.col(f"`{seq}`").isNull().alias("late"), F.col(f"`{seq}`").alias("seq")]
    if prefer is not None:
        order = [prefer.isNull().alias("none"), (-prefer).alias("prefer"), *order]
    place = F.struct(*order, digests.row_digest(df.columns).alias("digest"))
    row = F.struct(*[F.col(f"`{n}`") for n in df.columns])
    keys = F.struct(*[F.col(f"`{n}`") for n in key])
    return df.select(keys.alias("_key"), place.alias("_place"), row.alias("_row"))


def duplicate_rows(
    df: DataFrame, key: Sequence[str], seq: str = "seq", prefer: Column | None = None
) -> DataFrame:
    """The rows beyond the one kept per key, redelivered copies with one arrival number included.

    Equal rows are counted before the shuffle, and rows are told apart by digest, so the join is spread evenly however
    often a key repeats.
    """
    rows = (
        _ranked(df, key, seq, prefer)
        .groupBy(F.col("_place.digest").alias("_digest"))
        .agg(
            F.any_value("_key").alias("_key"),
            F.any_value("_place").alias("_place"),
            F.any_value("_row").alias("_row"),
            F.count("*").alias("_copies"),
        )
    )
    kept = rows.groupBy("_key").agg(F.min("_place").alias("_best")).select(
        F.col("_best.digest").alias("_digest"), F.lit(1).alias("_kept")
    )
    surplus = F.col("_copies") - F.coalesce(F.col("_kept"), F.lit(0))
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_surplus"))).alias("_copy")
    return (
        rows.join(kept, "_digest", "left")
        .select("_row", surplus.alias("_surplus"))
        .filter("_surplus > 0")
        .select("_row", each)
        .select("_row.*")
    )


def dedupe_keep_first(
    df: DataFrame, key: Sequence[str], seq: str = "seq", prefer: Column | None = None
) -> DataFrame:
    """One row per key, in one pass over the table."""
    best = _ranked(df, key, seq, prefer).groupBy("_key").agg(F.min_by("_row", "_place").alias("_row"))
    return best.select("_row.*")


# --- Assertions and rules ---------------------------------------------------


def transform_errors(
    original: DataFrame,
    transformed: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    key: str,
) -> DataFrame:
    """One row: compared pairs and pairs whose output is not what ``transform`` gives.

    Pairs are matched on a unique key; a row missing on either side is not compared.
    """
    expected = transform(original)
    columns = [c for c in expected.columns if c != key]
    left = expected.select(key, F.struct(*columns).alias("_expected"))
    right = transformed.select(key, F.struct(*columns).alias("_actual"))
    wrong = ~F.col("_actual").eqNullSafe(F.col("_expected"))
    return left.join(right, key).agg(F.count("*").alias("compared"), F.count_if(wrong).alias("errors"))


def with_total(records: DataFrame) -> DataFrame:
    return records.withColumn("total", F.col("a") + F.col("b"))


def sum_broken() -> Column:
    zero = F.lit(0)
    return F.coalesce("a", zero) + F.coalesce("b", zero) != F.coalesce("total", zero)


def negative_id() -> Column:
    return F.coalesce(F.col("id"), F.lit(0)) < 0


@dataclass(frozen=True)
class Rule:
    """A named predicate that holds for violating rows: a Column or SQL text."""

    name: str
    predicate: Column | str

    def column(self) -> Column:
        return F.expr(self.predicate) if isinstance(self.predicate, str) else self.predicate


def rule_violations(df: DataFrame, rules: Sequence[Rule | tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(rule, violations). All predicate rules share one aggregate over the frame.

    A rule may also be a name with a function returning violating rows, for rules that
    look at more than one row; each of those is an aggregate of its own.
    """
    row_rules = [r for r in rules if isinstance(r, Rule)]
    set_rules = [r for r in rules if not isinstance(r, Rule)]
    parts = []
    if row_rules:
        names = [r.name for r in row_rules]
        counted = df.agg(*[F.count_if(r.column()).alias(r.name) for r in row_rules])
        parts.append(counted.unpivot([], names, "rule", "violations"))
    for name, violating in set_rules:
        parts.append(violating(df).agg(F.lit(name).alias("rule"), F.count("*").alias("violations")))
    if not parts:
        return df.sparkSession.createDataFrame([], "rule string, violations bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
