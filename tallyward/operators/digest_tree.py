"""Checksum reconciliation that finds the rows: a tree of bucket digests over the hashes of keys.

Both sides are summed per bucket of the key's hash. Where the sums of a bucket agree, its rows are equal (up to the chance
that two different sums of 60-bit digests agree) and are not looked at again; the others are split into finer buckets, and
only the rows of the last buckets that differ are compared by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions import digests

# Bits of the key's hash that name a bucket, level by level.
LEVELS = (10, 20)
_WIDTH = 60


def _sides(source: DataFrame, target: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of both sides: key, 60 bits of its hash, 60-bit digest of the row, +1 or -1."""

    def side(df: DataFrame, sign: int) -> DataFrame:
        names = F.struct(*[F.col(f"`{c}`") for c in key])
        word = F.conv(F.substring(digests.row_digest([*key, *columns]), 1, 15), 16, 10).cast("decimal(38,0)")
        hashed = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in key]), 64 - _WIDTH)
        return df.select(names.alias("_key"), hashed.alias("_hash"), word.alias("_word"), F.lit(sign).cast("long").alias("_sign"))

    return side(source, 1).unionByName(side(target, -1))


def _bucket(bits: int) -> Column:
    return F.shiftright("_hash", _WIDTH - bits)


def unequal_buckets(rows: DataFrame, bits: int) -> DataFrame:
    """Buckets of the given width whose sums differ. Sums collapse in each task before they travel."""
    return (
        rows.groupBy(_bucket(bits).alias("_bucket"))
        .agg(
            F.sum("_sign").alias("_rows"),
            F.sum(F.col("_sign") * F.col("_word")).alias("_sum"),
            F.sum(F.col("_sign") * (F.col("_word") % 2147483647) * (F.col("_word") % 2147483629)).alias("_product"),
        )
        .filter("_rows != 0 OR _sum != 0 OR _product != 0")
        .select("_bucket")
    )


def rows_of_unequal_buckets(rows: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """The rows that remain after descending into the buckets that differ."""
    for bits in levels:
        rows = rows.withColumn("_bucket", _bucket(bits)).join(unequal_buckets(rows, bits), "_bucket", "left_semi").drop("_bucket")
    return rows


def differing_keys(
    source: DataFrame, target: DataFrame, key: Sequence[str], columns: Sequence[str], levels: Sequence[int] = LEVELS
) -> DataFrame:
    """Keys whose rows are not the same on both sides: key columns, status (missing, unexpected, changed), and the rows
    of each side. Repeated keys agree if the same rows are there equally often; a null is a value like any other."""
    rows = rows_of_unequal_buckets(_sides(source, target, key, columns), levels)
    both = rows.groupBy("_key", "_word").agg(
        F.count_if(F.col("_sign") > 0).alias("_s"), F.count_if(F.col("_sign") < 0).alias("_t")
    )
    per_key = both.groupBy("_key").agg(
        F.sum("_s").alias("source_rows"), F.sum("_t").alias("target_rows"), F.bool_or(F.col("_s") != F.col("_t")).alias("_differ")
    )
    status = (
        F.when(F.col("target_rows") == 0, "missing").when(F.col("source_rows") == 0, "unexpected").otherwise("changed")
    )
    return per_key.filter("_differ").select("_key.*", status.alias("status"), "source_rows", "target_rows")
