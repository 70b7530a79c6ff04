"""Reproducible fault injection: DataFrame in, DataFrame out, labels kept in ``faults``.

Sampling hashes the row's own arrival number, so a rerun of any task picks the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Union

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions import digests, parsing
from tallyward.model import CORRUPTION, DUPLICATION, INCONSISTENCY, SCHEMA_DRIFT
from tallyward.operators.ordering import dense_position, smallest_k

# A share of rows: one number, or a column where rows of several scenarios differ.
Rate = Union[float, Column]

DRIFTED, BROKEN_CHECKSUM = "N/A", "invalid"

# Rows a swap group holds on average; groups grow in number with the table.
SWAP_GROUP_ROWS = 4096


def _label(name: str, when: Column | None = None) -> Column:
    added = F.array_append(F.coalesce(F.col("faults"), F.array().cast("array<string>")), F.lit(name))
    return added if when is None else F.when(when, added).otherwise(F.col("faults"))


def next_seq(df: DataFrame, seq: str = "seq") -> Column:
    """First unused arrival number, as a scalar subquery."""
    return df.agg(F.coalesce(F.max(seq) + 1, F.lit(0))).scalar()


# --- Order events -----------------------------------------------------------


def inject_missing(events: DataFrame, rate: Rate = 0.1) -> DataFrame:
    return events.filter(~digests.sampled("drop", F.col("seq"), rate))


def missing_rows(events: DataFrame, rate: Rate = 0.1) -> DataFrame:
    """Ground truth of :func:`inject_missing`: the rows it takes away."""
    return events.filter(digests.sampled("drop", F.col("seq"), rate))


def inject_duplicates(events: DataFrame, rate: Rate = 0.1, offset: Column | None = None) -> DataFrame:
    """Copies of sampled rows arrive after everything else, in the same relative order.

    A copy's arrival number is the original's plus ``offset``, by default the first
    unused number. Originals and copies come out of the same scan.
    """
    offset = next_seq(events) if offset is None else offset
    once, twice = F.array(F.lit(False)), F.array(F.lit(False), F.lit(True))
    copies = F.when(digests.sampled("dup", F.col("seq"), rate), twice).otherwise(once)
    spread = events.select(*events.columns, F.explode(copies).alias("_copy"))
    return spread.withColumns(
        {
            "seq": F.when(F.col("_copy"), F.col("seq") + offset).otherwise(F.col("seq")),
            "faults": _label(DUPLICATION, F.col("_copy")),
        }
    ).select(*events.columns)


def inflated(amount: Column) -> Column:
    """Ten times the amount and one; what is no number stays."""
    return F.coalesce((parsing.to_decimal(amount) * 10 + 1).cast("decimal(20,2)").cast("string"), amount)


def inject_corruption(events: DataFrame, rate: Rate = 0.1) -> DataFrame:
    hit = digests.sampled("corrupt", F.col("seq"), rate)
    return events.withColumns(
        {
            "amount": F.when(hit, inflated(F.col("amount"))).otherwise(F.col("amount")),
            "checksum": F.when(hit, F.lit(BROKEN_CHECKSUM)).otherwise(F.col("checksum")),
            "faults": _label(CORRUPTION, hit),
        }
    )


def inject_schema_drift(events: DataFrame, rate: Rate = 0.1) -> DataFrame:
    hit = digests.sampled("drift", F.col("seq"), rate)
    return events.withColumns(
        {
            "amount": F.when(hit, F.lit(DRIFTED)).otherwise(F.col("amount")),
            "faults": _label(SCHEMA_DRIFT, hit),
        }
    )


def inject_out_of_order(
    events: DataFrame, rate: Rate = 0.1, upper: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """About n x rate disjoint swaps of two rows' arrival numbers.

    Twice the rate is sampled and paired inside hash groups, whose number follows
    ``upper``, by default the first unused arrival number. Only sampled rows are
    shuffled; an odd one out stays where it is.
    """
    seq = F.col("seq")
    if isinstance(rate, Column):
        share = F.when(rate > 0.5, F.raise_error(F.lit("at most half of the rows can lead a swap"))).otherwise(rate * 2)
    elif rate > 0.5:
        raise ValueError("at most half of the rows can lead a swap: the rate must not exceed 0.5")
    else:
        share = 2 * rate
    sample = digests.sampled("ooo", seq, share)
    upper = next_seq(events) if upper is None else upper
    groups = F.greatest(F.lit(1), F.ceil(upper / F.lit(SWAP_GROUP_ROWS))).cast("bigint")
    picked = events.filter(sample).withColumn("_group", digests.hash32("oooG", seq) % groups)
    w = Window.partitionBy(*by, "_group").orderBy(digests.hash32("ooo", seq), seq)
    paired = picked.withColumns(
        {
            "_rank": F.row_number().over(w),
            "_next": F.lead("seq").over(w),
            "_prev": F.lag("seq").over(w),
        }
    ).withColumn("_partner", F.when(F.col("_rank") % 2 == 1, F.col("_next")).otherwise(F.col("_prev")))
    moved = paired.withColumns(
        {
            "faults": _label(INCONSISTENCY, F.col("_partner").isNotNull()),
            "seq": F.coalesce(F.col("_partner"), seq),
        }
    ).select(*events.columns)
    return events.filter(~sample).unionByName(moved)


# --- Records with an exact number of faults ---------------------------------


def _share_of(total: Column, rate: float) -> Column:
    """floor(rows x rate), in decimal arithmetic."""
    return F.floor(total.cast("decimal(20,0)") * F.lit(str(rate)).cast("decimal(10,6)")).cast("bigint")


def _rows(df: DataFrame) -> Column:
    return df.agg(F.count("*")).scalar()


def inject_tail_loss(df: DataFrame, rate: float = 0.1, order: str = "id") -> DataFrame:
    """Drop the last floor(n x rate) rows in arrival order."""
    placed = dense_position(df, "_pos", order)
    total = _rows(df)
    return placed.filter(F.col("_pos") < total - _share_of(total, rate)).select(*df.columns)


def inject_exact_duplicates(df: DataFrame, rate: float = 0.1, order: str = "id") -> DataFrame:
    """Append floor(n x rate) copies of rows drawn with replacement.

    Draw ``i`` picks position ``hash(i) mod n``. Draw numbers are taken from the table's
    own positions, so the draws are as distributed as the rows.
    """
    placed = dense_position(df, "_pos", order)
    total = _rows(df)
    draws = (
        placed.filter(F.col("_pos") < _share_of(total, rate))
        .select((digests.hash60("exactdup", F.col("_pos")) % total).alias("_pos"))
        .groupBy("_pos")
        .agg(F.count("*").alias("_draws"))
    )
    copies = placed.join(draws, "_pos").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_draws").cast("int")))
    )
    return df.unionByName(copies.select(*df.columns))


def inject_exact_corruption(
    df: DataFrame, rate: float = 0.1, fields: Sequence[str] | None = None, order: str = "id"
) -> DataFrame:
    """Exactly floor(n x rate) rows get one field changed: integers doubled, text suffixed."""
    names = list(fields or df.columns)
    hit = smallest_k(df, lambda total: _share_of(total, rate), "exactcorrupt", order)
    choice = digests.bucket("field", F.col(order), len(names))
    flagged = df.withColumns({"_hit": hit, "_field": choice})
    changed = []
    for name in df.columns:
        col, dtype = F.col(name), df.schema[name].dataType
        if name in names and isinstance(dtype, (T.IntegralType, T.StringType)):
            new = col * 2 if isinstance(dtype, T.IntegralType) else F.concat(col, F.lit("_corrupt"))
            mine = F.col("_hit") & (F.col("_field") == names.index(name))
            col = F.when(mine, new.cast(dtype)).otherwise(col)
        changed.append(col.alias(name))
    return flagged.select(*changed)


def inject_negative_id(df: DataFrame, rate: float = 0.1, order: str = "id") -> DataFrame:
    """Exactly floor(n x rate) rows get id -1."""
    hit = smallest_k(df, lambda total: _share_of(total, rate), "negative", order)
    return df.withColumn("id", F.when(hit, F.lit(-1).cast("bigint")).otherwise(F.col("id")))
