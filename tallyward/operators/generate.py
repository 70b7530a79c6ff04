"""Reproducible order events and AB records, one row per input number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions import digests
from tallyward.functions.scalars import padded
from tallyward.model import ORDER_STATUSES

DEFAULT_START = "2024-01-01T00:00:00"
STEP_SECONDS = 10


def no_faults() -> Column:
    return F.array().cast("array<string>")


def order_events(numbers: DataFrame, start: str = DEFAULT_START, seed: int = 42) -> DataFrame:
    """Order events for a frame with a ``seq`` column: 10 seconds apart, amounts 10.00..500.00."""
    seq = F.col("seq")
    cents = digests.between(f"amount{seed}", seq, 1_000, 50_000)
    status = F.element_at(
        F.array(*[F.lit(s) for s in ORDER_STATUSES]),
        digests.between(f"status{seed}", seq, 1, len(ORDER_STATUSES)).cast("int"),
    )
    event_time = F.lit(start).cast("timestamp_ntz") + F.make_interval(
        secs=(seq * STEP_SECONDS).cast("decimal(18,6)")
    )
    body = numbers.select(
        seq,
        padded("order-", seq, 6).alias("event_id"),
        F.date_format(event_time, "yyyy-MM-dd'T'HH:mm:ss").alias("event_time"),
        padded("cust-", digests.between(f"customer{seed}", seq, 1, 100), 3).alias("customer_id"),
        F.lit("web").alias("source_system"),
        (cents.cast("decimal(18,0)") / 100).cast("decimal(18,2)").cast("string").alias("amount"),
        status.alias("status"),
        F.lit("1").alias("version"),
    )
    return body.withColumns(
        {
            "checksum": digests.event_checksum(
                F.col("event_id"), F.col("customer_id"), F.col("amount"), F.col("event_time")
            ),
            "faults": no_faults(),
        }
    )


def generate_orders(spark: SparkSession, n: int, start: str = DEFAULT_START, seed: int = 42) -> DataFrame:
    return order_events(spark.range(n).withColumnRenamed("id", "seq"), start, seed)


def ab_records(numbers: DataFrame, seed: int = 42) -> DataFrame:
    """AB records for a frame with an ``id`` column; a and b lie in 1..100."""
    key = F.col("id")
    return numbers.select(
        key,
        digests.between(f"a{seed}", key, 1, 100).alias("a"),
        digests.between(f"b{seed}", key, 1, 100).alias("b"),
    )


def generate_ab(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    return ab_records(spark.range(n), seed)
