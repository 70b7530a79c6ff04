"""Findings, ground truth and the scores between them.

Both are long tables with one row per (event_id, seq, category). A row may carry several
categories: a copy of a corrupted row is both a duplicate and corrupted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.scalars import ratio_or
from tallyward.model import CATEGORIES, CORRUPTION, DUPLICATION, INCONSISTENCY, LOSS, SCHEMA_DRIFT
from tallyward.model import MALFORMED, INVALID_SCHEMA, NULLS, TRANSFORMATION_FAILURES, TYPE_MISMATCHES
from tallyward.operators.checks import STORED, annotate
from tallyward.operators.ordering import dense_position

# Which stage and check a rejection belongs to.
_REJECTIONS = {
    INVALID_SCHEMA: ("Ingestion", "schema_validation", SCHEMA_DRIFT),
    NULLS: ("Ingestion", "null_check", SCHEMA_DRIFT),
    MALFORMED: ("Transformation", "type_validation", SCHEMA_DRIFT),
    TYPE_MISMATCHES: ("Transformation", "type_validation", SCHEMA_DRIFT),
    TRANSFORMATION_FAILURES: ("Transformation", "assertion_check", INCONSISTENCY),
}


def _finding(stage: str, check: str, category: str) -> Column:
    return F.struct(
        F.lit(stage).alias("stage"), F.lit(check).alias("check"), F.lit(category).alias("category")
    )


def row_findings(annotated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Findings a row shows by itself: its rejection and its checksum."""
    rejection = F.lit(None)
    for reason, (stage, check, category) in _REJECTIONS.items():
        rejection = F.when(F.col("outcome") == reason, _finding(stage, check, category)).otherwise(rejection)
    checksum = F.when(
        (F.col("outcome") == STORED) & ~F.col("checksum_ok"),
        _finding("Preprocessing", "checksum_validate", CORRUPTION),
    )
    found = F.array_compact(F.array(rejection, checksum))
    return annotated.select(*by, "event_id", "seq", F.inline(found))


def key_facts(received: DataFrame, source: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per event id: first arrival in the source and among the received rows.

    One shuffle serves loss, duplicates and order.
    """
    nothing = F.lit(None).cast("bigint")
    both = source.select(*by, "event_id", F.col("seq").alias("_s"), nothing.alias("_r")).unionByName(
        received.select(*by, "event_id", nothing.alias("_s"), F.col("seq").alias("_r"))
    )
    return both.groupBy(*by, "event_id").agg(F.min("_s").alias("source_seq"), F.min("_r").alias("first_seq"))


def displaced(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ids both sides have whose rank differs between source and arrival.

    Ranking only what both sides have keeps a lost row from shifting all that follow.
    Both ranks come from one pass over two rows per id.
    """
    keys = [*by, "event_id"]
    sides = F.array(
        F.struct(F.lit("source").alias("_side"), F.col("source_seq").alias("_order")),
        F.struct(F.lit("arrival").alias("_side"), F.col("first_seq").alias("_order")),
    )
    shared = facts.filter(F.col("source_seq").isNotNull() & F.col("first_seq").isNotNull())
    ranked = dense_position(shared.select(*keys, F.inline(sides)), "_rank", "_order", [*by, "_side"])
    return (
        ranked.groupBy(*keys)
        .agg(
            F.min("_rank").alias("_low"),
            F.max("_rank").alias("_high"),
            F.max(F.when(F.col("_side") == "arrival", F.col("_order"))).alias("first_seq"),
        )
        .filter(F.col("_low") != F.col("_high"))
    )


def findings(received: DataFrame, source: DataFrame, as_of: str, by: Sequence[str] = ()) -> DataFrame:
    """Everything the checks find: (by, event_id, seq, stage, check, category)."""
    return findings_of(annotate(received, as_of), source, by)


def findings_of(received: DataFrame, source: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`findings` of received rows that are already annotated."""
    keep = [*by, "event_id"]
    facts = key_facts(received, source, by)
    lost = facts.filter(F.col("first_seq").isNull()).select(*keep, F.col("source_seq").alias("seq"))
    moved = displaced(facts, by).select(*keep, F.col("first_seq").alias("seq"))
    # Arrival numbers are unique, so telling first arrivals apart by them spreads evenly.
    surplus = received.select(*keep, "seq").join(
        facts.filter(F.col("first_seq").isNotNull()).select(*by, F.col("first_seq").alias("seq")),
        [*by, "seq"],
        "left_anti",
    )

    def tag(df: DataFrame, stage: str, check: str, category: str) -> DataFrame:
        return df.select(
            *keep, "seq", F.lit(stage).alias("stage"), F.lit(check).alias("check"), F.lit(category).alias("category")
        )

    return (
        row_findings(received, by)
        .unionByName(tag(surplus, "Preprocessing", "duplicate_detection", DUPLICATION))
        .unionByName(tag(lost, "Storage", "row_count_check", LOSS))
        .unionByName(tag(moved, "Output", "downstream_validation", INCONSISTENCY))
    )


def truth(received: DataFrame, lost: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What was injected: labels of the received rows, and the rows taken away."""
    keep = [*by, "event_id", "seq"]
    labels = received.select(*keep, F.explode(F.array_distinct("faults")).alias("category"))
    return labels.unionByName(lost.select(*keep, F.lit(LOSS).alias("category")))


def matches(found: DataFrame, injected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group and category: true positives, false positives, false negatives."""
    keys = [*by, "event_id", "seq", "category"]
    one, none = F.lit(1), F.lit(0)
    both = found.select(*keys, one.alias("_f"), none.alias("_t")).unionByName(
        injected.select(*keys, none.alias("_f"), one.alias("_t"))
    )
    per_key = both.groupBy(*keys).agg(F.max("_f").alias("_f"), F.max("_t").alias("_t"))
    return per_key.groupBy(*by, "category").agg(
        F.count_if((F.col("_f") == 1) & (F.col("_t") == 1)).alias("true_positives"),
        F.count_if((F.col("_f") == 1) & (F.col("_t") == 0)).alias("false_positives"),
        F.count_if((F.col("_f") == 0) & (F.col("_t") == 1)).alias("false_negatives"),
    )


def scores(counts: DataFrame) -> DataFrame:
    """Add precision, recall, F1 and accuracy to frames with the three match counts.

    Nothing flagged gives precision 1.0; nothing injected gives accuracy 1.0; nothing to
    find gives recall 1.0. Accuracy is what was flagged per injected fault, so it exceeds recall where flags are false.
    """
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    precision, recall = ratio_or(tp, tp + fp, 1.0), ratio_or(tp, tp + fn, 1.0)
    return counts.withColumns({"precision": precision, "recall": recall}).withColumns(
        {
            "f1": F.coalesce(
                F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
                F.lit(0.0),
            ),
            "detection_accuracy": ratio_or(F.when(tp + fn > 0, tp + fp), tp + fn, 1.0),
        }
    )


def detected_counts(counts: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per group in ``groups``: match totals and found counts per category."""
    sums = ("true_positives", "false_positives", "false_negatives")

    def found(*categories: str) -> Column:
        hit = F.col("category").isin(*categories)
        return F.coalesce(
            F.sum(F.when(hit, F.col("true_positives") + F.col("false_positives"))), F.lit(0)
        )

    zero = [F.lit(0).cast("bigint").alias(n) for n in sums]
    stacked = counts.select(*by, "category", *sums).unionByName(
        groups.select(*by, F.lit(None).cast("string").alias("category"), *zero)
    )
    return stacked.groupBy(*by).agg(
        *[F.sum(n).alias(n) for n in sums],
        found(LOSS).alias("detected_loss"),
        found(DUPLICATION).alias("detected_duplicates"),
        found(CORRUPTION, SCHEMA_DRIFT).alias("detected_corruption"),
        found(INCONSISTENCY).alias("detected_inconsistency"),
    )


def by_category(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Findings counted per category, one column each."""
    return found.groupBy(*by).agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])


def published_scores(row: DataFrame, source_rows: Column, detected: Column, stored: Column) -> DataFrame:
    """The simple published scores: any finding is precision 1, recall is found per source row."""
    return row.withColumns(
        {
            "precision": F.when(detected > 0, 1.0).otherwise(0.0),
            "recall": ratio_or(detected, source_rows, 0.0),
            "false_positives": F.lit(0).cast("bigint"),
            "false_negatives": F.greatest(F.lit(0).cast("bigint"), source_rows - stored),
        }
    )
