"""The given tables seen as order events and as AB records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions import digests
from tallyward.functions.scalars import padded
from tallyward.operators.generate import no_faults


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan that gives fewer partitions than there are cores, such as a file of one row group, dealt evenly.

    A scan that already gives enough partitions is left as it is. Only the layout of the rows changes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def order_events(orders: DataFrame, *extra: str) -> DataFrame:
    """Raw order events, one per order; ``extra`` columns are carried along in front."""
    status = (
        F.when(F.col("o_orderstatus") == "O", "created")
        .when(F.col("o_orderstatus") == "P", "paid")
        .when(F.col("o_orderstatus") == "F", "shipped")
    )
    body = orders.select(
        *extra,
        F.col("o_orderkey").alias("seq"),
        padded("order-", F.col("o_orderkey"), 6).alias("event_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("event_time"),
        padded("cust-", F.col("o_custkey"), 6).alias("customer_id"),
        F.lit("web").alias("source_system"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"),
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


def ab_view(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.select(
        key.alias("id"),
        digests.between("a42", key, 1, 100).alias("a"),
        digests.between("b42", key, 1, 100).alias("b"),
    )
