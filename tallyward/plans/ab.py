"""The checked flow over AB records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyward.operators.integrity import negative_id, sum_broken, with_total


def detections(records: DataFrame, expected: Column) -> DataFrame:
    """One row with the five counts and their sum.

    Transform errors compare each row with the transform of the very same row, so they
    are counted in the pass over the rows; duplicates and missing ids come from one
    aggregate per id, which carries the row counts along.
    """
    rows = with_total(records)
    wrong_total = ~F.col("total").eqNullSafe(F.col("a") + F.col("b"))
    per_id = rows.groupBy("id").agg(
        F.count("*").alias("_copies"),
        F.count_if(wrong_total).alias("_wrong"),
        F.count_if(sum_broken()).alias("_broken"),
        F.count_if(negative_id()).alias("_negative"),
    )
    inside = (F.col("id") >= 0) & (F.col("id") < expected)
    out = per_id.agg(
        F.coalesce(F.sum("_wrong"), F.lit(0)).alias("transform_errors"),
        F.coalesce(F.sum("_broken"), F.lit(0)).alias("integrity_errors"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_errors"),
        (expected - F.count_if(inside)).alias("data_loss_errors"),
        F.coalesce(F.sum("_negative"), F.lit(0)).alias("inconsistency_errors"),
    )
    total = (
        F.col("transform_errors")
        + F.col("integrity_errors")
        + F.col("duplicate_errors")
        + F.col("data_loss_errors")
        + F.col("inconsistency_errors")
    )
    return out.withColumn("detections", total)
