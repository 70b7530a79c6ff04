"""Curated table, stored-row count and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyward.functions.scalars import percent_text
from tallyward.model import CURATED_EVENT


def write_curated(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace the curated table at ``path``; columns are cast to its fixed schema."""
    out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CURATED_EVENT.fields])
    if partition_by:
        out = out.withColumn(partition_by, rows[partition_by])
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_observed(rows: DataFrame, path: str, **measures: Column) -> dict[str, object]:
    """Replace the Parquet table at ``path`` and return what was written: ``rows`` and the aggregates ``measures``.

    The aggregates are computed by the write itself, so the rows are evaluated once; of a task that ran again after a
    failure only the attempt that succeeded counts.
    """
    seen = Observation(f"write-{uuid.uuid4().hex}")
    counted = rows.observe(seen, F.count("*").alias("rows"), *[m.alias(n) for n, m in measures.items()])
    counted.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return dict(seen.get)


def write_accounted(rows: DataFrame, path: str, expected: int | None = None) -> DataFrame:
    """One row: rows written by this write, rows that Parquet footers at ``path`` hold after it, and whether they are equal.

    With ``expected`` they must also equal it.
    """
    written = write_observed(rows, path)["rows"]
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path).agg(F.count("*").alias("stored_rows"))
    same = F.col("stored_rows") == written
    if expected is not None:
        same &= F.lit(expected == written)
    return stored.select(F.lit(written).cast("bigint").alias("written_rows"), "stored_rows", same.alias("complete"))


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CURATED_EVENT).parquet(path)


def stored_count(spark: SparkSession, path: str) -> DataFrame:
    """Rows actually at ``path``; parquet answers this from its footers."""
    return read_curated(spark, path).agg(F.count("*").alias("stored_rows"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def report_rows(experiments: DataFrame) -> DataFrame:
    """The exported report: accuracies and their difference as percent text."""
    gain = F.col("proposed_accuracy") - F.col("baseline_accuracy")
    return experiments.select(
        F.col("id").alias("experiment_id"),
        "scenario",
        percent_text(F.col("baseline_accuracy")).alias("baseline_accuracy"),
        percent_text(F.col("proposed_accuracy")).alias("proposed_accuracy"),
        percent_text(gain).alias("improvement"),
    )


def report_json(summary: DataFrame, experiments: DataFrame) -> DataFrame:
    """JSON lines, one object each: a ``summary`` object, then an ``experiments`` object per run.

    One line per run rather than one array, so that the history can grow without any
    task holding it whole.
    """
    head = summary.select(F.to_json(F.struct(F.struct("*").alias("summary"))).alias("value"))
    body = experiments.select(F.to_json(F.struct(F.struct("*").alias("experiments"))).alias("value"))
    return head.unionByName(body)


def export_json(summary: DataFrame, experiments: DataFrame, path: str) -> None:
    report_json(summary, experiments).write.mode("overwrite").text(path)
