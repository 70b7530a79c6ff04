"""Positions and exact-size samples without a single-task sort.

``row_number()`` over a window with no partition sends the whole table to one task.
The operators here split the order into fixed-width blocks instead, on four levels: with a unique order
column no window holds more than ``2**18`` rows or counts, however sparse the order values are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions import digests

BLOCK_BITS, SUPER_BITS = 14, 18  # 14 of 64 bits remain for the window over the largest blocks
_UNORDERED = 1 << 50  # above all blocks of order values


def block_of(order: str) -> Column:
    """Block number of an order value."""
    return F.shiftright(F.col(order).cast("bigint"), BLOCK_BITS)


def _over(within: Sequence[str], order: str, last: str) -> str:
    """A window up to ``last``, as text: plans with many sums are built from few calls."""
    parts = f"PARTITION BY {', '.join(f'`{c}`' for c in within)} " if within else ""
    return f"({parts}ORDER BY `{order}` ROWS BETWEEN UNBOUNDED PRECEDING AND {last})"


def _running_before(within: Sequence[str], order: str, cols: Mapping[str, str]) -> list[Column]:
    over = _over(within, order, "1 PRECEDING")
    return [F.expr(f"coalesce(sum(`{src}`) OVER {over}, 0) AS `{out}`") for src, out in cols.items()]


def _block_offsets(counts: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows before each block: prefix sums inside each of two levels of larger blocks, then over the largest."""
    supers = counts.withColumns(
        {"_super": F.shiftright("_block", SUPER_BITS), "_top": F.shiftright("_block", 2 * SUPER_BITS)}
    )
    inner = supers.select("*", *_running_before([*by, "_super"], "_block", {n: f"{n}_in" for n in names}))
    per_super = supers.groupBy(*by, "_top", "_super").agg(*[F.expr(f"sum(`{n}`) AS `{n}`") for n in names])
    middle = per_super.select(*by, "_top", "_super", *names, *_running_before([*by, "_top"], "_super", {n: f"{n}_mid" for n in names}))
    # One row per 2**(BLOCK_BITS + 2 * SUPER_BITS) order values, so at most 2**14 rows.
    outer = per_super.groupBy(*by, "_top").agg(*[F.expr(f"sum(`{n}`) AS `{n}`") for n in names])
    outer = outer.select(*by, "_top", *_running_before(by, "_top", {n: f"{n}_out" for n in names}))
    above = middle.join(outer, [*by, "_top"]).select(
        *by, "_super", *[F.expr(f"`{n}_mid` + `{n}_out` AS `{n}_above`") for n in names]
    )
    return inner.join(above, [*by, "_super"]).select(
        *by, "_block", *[F.expr(f"`{n}_in` + `{n}_above` AS `{n}_before`") for n in names]
    )


def dense_positions(
    df: DataFrame,
    positions: Mapping[str, Column | str],
    order: str = "seq",
    by: Sequence[str] = (),
) -> DataFrame:
    """Add, per named predicate, the zero-based position among the rows that satisfy it.

    Rows that fail a predicate get null for it, and so do rows without an order value. Among the rows of one predicate
    ``order`` must else be a unique integer within ``by``. The rows are shuffled once, by block.
    """
    names = {p: f"_n_{p}" for p in positions}
    ordered = F.col(order).isNotNull()
    flags = {
        names[p]: F.expr(f"CASE WHEN ({c}) AND `{order}` IS NOT NULL THEN 1L ELSE 0L END")
        if isinstance(c, str)
        else F.when(c & ordered, 1).otherwise(0).cast("bigint")
        for p, c in positions.items()
    }
    counted = df.filter(ordered).select(*by, block_of(order).alias("_block"), *[c.alias(n) for n, c in flags.items()])
    counts = counted.groupBy(*by, "_block").agg(*[F.expr(f"sum(`{n}`) AS `{n}`") for n in names.values()])
    offsets = _block_offsets(counts, by, list(names.values()))
    # Rows without an order value get no position; each is a block of its own, so that they spread.
    block = F.coalesce(block_of(order), F.monotonically_increasing_id() + F.lit(_UNORDERED))
    # Dealt before the flags are there, which need not be shuffled.
    flagged = df.withColumn("_block", block).repartition(*by, "_block").withColumns(flags)
    over = _over([*by, "_block"], order, "CURRENT ROW")
    local = flagged.select("*", *[F.expr(f"sum(`{n}`) OVER {over} AS `{n}_local`") for n in names.values()])
    placed = local.join(offsets, [*by, "_block"], "left")
    return placed.select(
        *df.columns,
        *[F.expr(f"CASE WHEN `{n}` = 1 THEN `{n}_before` + `{n}_local` - 1 END AS `{p}`") for p, n in names.items()],
    )


def small_group_positions(
    df: DataFrame, positions: Mapping[str, Column], by: Sequence[str], order: str = "seq"
) -> DataFrame:
    """:func:`dense_positions` for groups that are known to be small: one window per group."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ordered = F.col(order).isNotNull()
    return df.withColumns(
        {
            p: F.when(cond & ordered, F.count_if(cond & ordered).over(upto) - 1)
            for p, cond in positions.items()
        }
    )


def dense_position(
    df: DataFrame, into: str = "position", order: str = "seq", by: Sequence[str] = ()
) -> DataFrame:
    return dense_positions(df, {into: F.lit(True)}, order, by)


def smallest_k(df: DataFrame, size: Callable[[Column], Column], salt: str, key: str = "seq") -> Column:
    """Predicate that holds for exactly ``size(row count)`` rows: those first in
    (hash of key, key) order.

    The cut value is found from two histograms of at most 65,536 hash buckets each and
    one tail; the rows themselves are neither sorted nor shuffled.
    """
    hashed = df.select(F.col(key).alias("_key"), digests.hash32(salt, F.col(key)).alias("_h")).select(
        "_key", "_h", F.shiftright("_h", 16).alias("_hi")
    )
    coarse = hashed.groupBy("_hi").agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.orderBy("_hi").rowsBetween(*_ALL_ROWS))
    first = _bucket_of_rank(coarse.withColumn("_rank", size(total)), "_hi")
    # ``first`` and ``second`` hold one row each, so broadcasting them is safe.
    fine = hashed.join(F.broadcast(first), "_hi").groupBy("_h", "_rank").agg(F.count("*").alias("_n"))
    second = _bucket_of_rank(fine, "_h")
    # Rows equal in all 32 bits: n / 2**32 of them.
    tail = hashed.join(F.broadcast(second), "_h").withColumn(
        "_place", F.row_number().over(Window.partitionBy("_h").orderBy("_key"))
    )
    cut = tail.filter(F.col("_place") == F.col("_rank"))
    last = cut.select(F.struct("_h", "_key")).scalar()
    place = F.struct(digests.hash32(salt, F.col(key)).alias("_h"), F.col(key).alias("_key"))
    return F.coalesce(F.col(key).isNotNull() & (place <= last), F.lit(False))


_ALL_ROWS = (Window.unboundedPreceding, Window.unboundedFollowing)


def _bucket_of_rank(histogram: DataFrame, col: str) -> DataFrame:
    """The bucket that holds the row of the given rank, with the rank counted inside it."""
    w = Window.orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("_n").over(w) - F.col("_n")
    return (
        histogram.withColumn("_before", before)
        .filter((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_n")))
        .select(col, (F.col("_rank") - F.col("_before")).alias("_rank"))
    )
