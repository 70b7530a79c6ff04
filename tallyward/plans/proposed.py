"""The checked flow: five stages over one annotated projection.

Stage metrics come out of one aggregate per event id, followed by one over all of them: duplicates and reconciliation
share the shuffle of the row counts. Order costs more only where rows are rejected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.model import (
    INVALID_SCHEMA,
    MALFORMED,
    NULLS,
    REJECT_REASONS,
    TRANSFORMATION_FAILURES,
    TYPE_MISMATCHES,
)
from tallyward.operators.checks import STORED, annotate, curated
from tallyward.operators.ordering import dense_positions, small_group_positions
from tallyward.operators.reconcile import positional_mismatches
from tallyward.plans.combine import combine
from tallyward.sources.sinks import stored_count, write_curated


def kept_rows(events: DataFrame, as_of: str) -> DataFrame:
    """The received rows that pass every rejecting check, raw columns kept."""
    return annotate(events, as_of).filter(F.col("outcome") == STORED).select(*events.columns)


def _counters(source_rows: int) -> dict[str, Column]:
    """What a received row adds to the totals of its id."""
    kept = F.col("outcome") == STORED
    return {
        "received": F.lit(1),
        "source": F.lit(source_rows),
        "kept": kept.cast("int"),
        "freshness_issues": F.col("stale").cast("int"),
        "checksum_mismatch_rows": (kept & ~F.col("checksum_ok")).cast("int"),
    } | {reason: (F.col("outcome") == reason).cast("int") for reason in REJECT_REASONS}


def _totals(counters: Sequence[str]) -> list[Column]:
    """Row metrics, duplicates and reconciliation from one row per id."""
    total = {n: F.coalesce(F.sum(n), F.lit(0)) for n in counters}
    surplus = F.coalesce(F.sum(F.greatest(F.col("kept") - 1, F.lit(0))), F.lit(0))
    return [
        total["received"].alias("ingested"),
        total[INVALID_SCHEMA].alias("invalid_schema"),
        total[NULLS].alias("nulls"),
        total["freshness_issues"].alias("freshness_issues"),
        total[TYPE_MISMATCHES].alias("type_mismatches"),
        total[MALFORMED].alias("malformed"),
        total[TRANSFORMATION_FAILURES].alias("transformation_failures"),
        (surplus > 0).cast("bigint").alias("mapping_issues"),
        total["kept"].alias("stored"),
        (total["checksum_mismatch_rows"] > 0).cast("bigint").alias("checksum_mismatch"),
        total["checksum_mismatch_rows"].alias("checksum_mismatch_rows"),
        surplus.alias("duplicate_rows"),
        F.count_if((F.col("source") > 0) & (F.col("kept") == 0)).alias("missing_ids"),
        F.count_if((F.col("source") == 0) & (F.col("kept") > 0)).alias("unexpected_ids"),
        total["source"].alias("compared_source_rows"),
    ]


def _against_itself(annotated: DataFrame, by: Sequence[str], small_groups: bool) -> DataFrame:
    """All totals of received rows compared with themselves: one aggregate per id, and positions where they can differ."""
    counters = _counters(1)
    rows = annotated.select(*by, "event_id", *[c.cast("bigint").alias(n) for n, c in counters.items()])
    per_id = rows.groupBy(*by, "event_id").agg(*[F.sum(n).alias(n) for n in counters])
    return combine(
        [per_id.groupBy(*by).agg(*_totals(list(counters))), _own_mismatches(annotated, by, small_groups)], by
    )


def _own_mismatches(annotated: DataFrame, by: Sequence[str], small_groups: bool) -> DataFrame:
    """Stored rows whose time is not that of the received row at the same position.

    With nothing rejected before it a stored row is its own counterpart, so without groups only the rows from the first
    rejected one on are given positions: none of a clean table. Of these, a row whose two positions agree needs no look-up.
    """
    narrow = annotated.select(*by, "seq", "event_time", "outcome")
    if not by:
        first = narrow.filter(F.col("outcome") != STORED).agg(F.min("seq")).scalar()
        narrow = narrow.filter(F.col("seq") >= first)
    positions = {"_source_pos": F.lit(True), "_kept_pos": F.col("outcome") == STORED}
    if small_groups:
        placed = small_group_positions(narrow, positions, by)
    else:
        placed = dense_positions(narrow, positions, by=by)

    def entry(pos: str, source_time: Column, kept_time: Column, sides: tuple[int, int]) -> Column:
        return F.when(
            F.col(pos).isNotNull(),
            F.struct(
                F.col(pos).cast("bigint").alias("_pos"),
                source_time.alias("_source_time"),
                kept_time.alias("_kept_time"),
                *[F.lit(n).alias(name) for name, n in zip(("_at_source", "_at_kept"), sides)],
            ),
        )

    time, nothing = F.col("event_time"), F.lit(None).cast("string")
    there, here = entry("_source_pos", time, nothing, (1, 0)), entry("_kept_pos", nothing, time, (0, 1))
    shifted = placed.filter(~F.col("_kept_pos").eqNullSafe(F.col("_source_pos")))
    met = (
        shifted.select(*by, F.inline(F.array_compact(F.array(there, here))))
        .groupBy(*by, "_pos")
        .agg(*[F.max(c).alias(c) for c in ("_source_time", "_kept_time", "_at_source", "_at_kept")])
    )
    differ = (
        (F.col("_at_source") > 0)
        & (F.col("_at_kept") > 0)
        & ~F.col("_kept_time").eqNullSafe(F.col("_source_time"))
    )
    return met.groupBy(*by).agg(F.count_if(differ).alias("order_mismatches"))


def _against_source(annotated: DataFrame, source: DataFrame, by: Sequence[str]) -> DataFrame:
    """All totals of received rows compared with the rows before the faults."""
    counters = _counters(0)
    rows = annotated.select(*by, "event_id", *[c.cast("bigint").alias(n) for n, c in counters.items()])
    empty = [F.lit(1 if n == "source" else 0).cast("bigint").alias(n) for n in counters]
    per_id = (
        rows.unionByName(source.select(*by, "event_id", *empty))
        .groupBy(*by, "event_id")
        .agg(*[F.sum(n).alias(n) for n in counters])
    )
    bad = positional_mismatches(source, annotated.filter(F.col("outcome") == STORED), by=by)
    return combine(
        [
            per_id.groupBy(*by).agg(*_totals(list(counters))),
            bad.groupBy(*by).agg(F.count("*").alias("order_mismatches")),
        ],
        by,
    )


def metrics(
    events: DataFrame,
    as_of: str,
    source: DataFrame | None = None,
    by: Sequence[str] = (),
    small_groups: bool = False,
) -> DataFrame:
    """All stage metrics, one row per group of ``by``.

    Without ``source`` the received rows are compared with themselves, which hides lost
    rows; pass the original rows to see them.
    """
    return metrics_of(annotate(events, as_of), source, by, small_groups)


def metrics_of(
    annotated: DataFrame,
    source: DataFrame | None = None,
    by: Sequence[str] = (),
    small_groups: bool = False,
) -> DataFrame:
    """:func:`metrics` of rows that are already annotated. ``small_groups``: each group fits one window of a task."""
    if source is None:
        row = _against_itself(annotated, by, small_groups)
    else:
        row = _against_source(annotated, source, by)
    rejected = F.lit(0)
    for reason in REJECT_REASONS:
        rejected = rejected + F.col(reason)
    row = row.withColumns(
        {
            "order_mismatches": F.coalesce("order_mismatches", F.lit(0)),
            # Every received row is either stored or rejected for one reason; ``run_batch`` also counts what is on storage.
            "row_count_mismatch": (F.col("stored") + rejected != F.col("ingested")).cast("bigint"),
            "reconciliation": (F.col("missing_ids") == 0) & (F.col("unexpected_ids") == 0),
        }
    )
    return _finish(row, by)


def _finish(row: DataFrame, by: Sequence[str]) -> DataFrame:
    """Derived columns under the names reports use."""
    detected = (
        F.col("invalid_schema")
        + F.col("nulls")
        + F.col("type_mismatches")
        + F.col("transformation_failures")
        + F.col("row_count_mismatch")
        + F.col("checksum_mismatch")
    )
    rate = F.col("order_mismatches").cast("double") / F.greatest(
        F.lit(1), F.col("compared_source_rows")
    ).cast("double")
    return row.select(
        *by,
        "ingested",
        "invalid_schema",
        "nulls",
        "freshness_issues",
        "type_mismatches",
        "malformed",
        "transformation_failures",
        "mapping_issues",
        "stored",
        "row_count_mismatch",
        "checksum_mismatch",
        F.col("reconciliation").alias("downstream_reconciliation"),
        rate.alias("out_of_order"),
        F.col("ingested").alias("source_count"),
        F.col("stored").alias("stored_rows"),
        F.col("stored").alias("proposed_stored_rows"),
        detected.alias("proposed_detected_issues"),
        "duplicate_rows",
        "checksum_mismatch_rows",
        "missing_ids",
        "unexpected_ids",
        "order_mismatches",
        "compared_source_rows",
    )


def run_batch(events: DataFrame, path: str, as_of: str, source: DataFrame | None = None) -> DataFrame:
    """Store the rows that pass at ``path`` and report the stage metrics.

    The stored rows are counted again after the write, so the row-count check compares
    what is on storage with what the checks let through.
    """
    write_curated(curated(annotate(events, as_of)), path)
    written = stored_count(events.sparkSession, path).withColumnRenamed("stored_rows", "_written")
    row = combine([metrics(events, as_of, source), written], ())
    names = [c for c in row.columns if c != "_written"]
    mismatch = (F.col("_written") != F.col("stored")).cast("bigint")
    return row.withColumns(
        {
            "row_count_mismatch": F.greatest("row_count_mismatch", mismatch),
            "stored_rows": F.col("_written"),
            "proposed_stored_rows": F.col("_written"),
            "proposed_detected_issues": F.col("proposed_detected_issues")
            - F.col("row_count_mismatch")
            + F.greatest("row_count_mismatch", mismatch),
        }
    ).select(*names)
