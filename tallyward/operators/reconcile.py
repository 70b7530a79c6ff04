"""Comparing a source with a target.

Key comparisons are written as a union of both sides followed by one aggregate per key.
That is one shuffle with partial aggregation, where a full outer join of two distinct key
sets takes three, and repeated keys collapse before they travel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyward.operators.ordering import BLOCK_BITS, SUPER_BITS, dense_position, dense_positions

# Groups of no more rows are counted by one task.
SMALL_GROUP_ROWS = 1 << 14


def side_counts(
    source: DataFrame, target: DataFrame, key: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Per key, how many rows each side has."""
    keys = [*by, *key]
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = source.select(*keys, one.alias("_s"), none.alias("_t")).unionByName(
        target.select(*keys, none.alias("_s"), one.alias("_t"))
    )
    return both.groupBy(*keys).agg(F.sum("_s").alias("source_rows"), F.sum("_t").alias("target_rows"))


def reconcile_keys(
    source: DataFrame, target: DataFrame, key: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Missing and unexpected distinct keys; equal key sets give ``reconciled``."""
    missing = F.count_if((F.col("source_rows") > 0) & (F.col("target_rows") == 0))
    unexpected = F.count_if((F.col("source_rows") == 0) & (F.col("target_rows") > 0))
    return side_counts(source, target, key, by).groupBy(*by).agg(
        missing.alias("missing"),
        unexpected.alias("unexpected"),
        ((missing == 0) & (unexpected == 0)).alias("reconciled"),
    )


def missing_intervals(df: DataFrame, expected: Column, id_col: str = "id") -> DataFrame:
    """Runs of expected ids 0..n-1 that are absent: (first, last, ids).

    Gaps are looked for between neighbours inside blocks of ids, and then between the ends of blocks on three larger
    levels, so no window holds more than 2^18 rows and the expected ids are never written out. ``expected`` is a literal
    or a scalar subquery. Null ids and those outside the range do not count.
    """
    ids = df.select(F.col(id_col).cast("bigint").alias("_first")).filter((F.col("_first") >= 0) & (F.col("_first") < expected))
    # The range is bounded by two ids that are there.
    one = df.sparkSession.range(1)
    ids = ids.unionByName(one.select(F.lit(-1).cast("bigint").alias("_first"))).unionByName(
        one.select(expected.cast("bigint").alias("_first"))
    )
    found: list[DataFrame] = []
    parts = ids.distinct().withColumn("_last", F.col("_first"))
    for bits in (BLOCK_BITS, BLOCK_BITS + SUPER_BITS, BLOCK_BITS + 2 * SUPER_BITS, 63):
        block = F.shiftright("_first", bits)
        inside = Window.partitionBy("_block").orderBy("_first")
        placed = parts.withColumn("_block", block).withColumn("_before", F.lag("_last").over(inside))
        found.append(placed.filter(F.col("_first") - F.col("_before") > 1))
        parts = placed.groupBy("_block").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    # The last level holds two blocks at most: -1 alone, and all else.
    ends = parts.withColumn("_before", F.lag("_last").over(Window.orderBy("_first"))).filter("_first - _before > 1")
    out = None
    for gaps in (*found, ends):
        rows = gaps.select((F.col("_before") + 1).alias("first"), (F.col("_first") - 1).alias("last"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("ids", F.col("last") - F.col("first") + 1)


def missing_ids(df: DataFrame, expected: Column, id_col: str = "id") -> DataFrame:
    """Expected ids 0..n-1 that are absent, one row each, written out from their intervals in runs of 4,096."""
    step = F.lit(1 << 12).cast("bigint")
    runs = missing_intervals(df, expected, id_col).select("last", F.explode(F.sequence("first", "last", step)).alias("_from"))
    upto = F.least(F.col("last"), F.col("_from") + step - 1)
    return runs.select(F.explode(F.sequence(F.col("_from"), upto)).alias("id"))


def missing_id_count(df: DataFrame, expected: Column, id_col: str = "id") -> DataFrame:
    """How many of the expected ids 0..n-1 are absent, without building the range."""
    inside = (F.col(id_col) >= 0) & (F.col(id_col) < expected)
    present = df.filter(inside).select(id_col).distinct()
    return present.agg((expected - F.count("*")).alias("missing"))


def row_count_reconcile(source: DataFrame, target: DataFrame, by: Sequence[str]) -> DataFrame:
    """Row counts per partition key of both sides and whether they agree."""
    return side_counts(source, target, by).withColumns(
        {
            "difference": F.col("target_rows") - F.col("source_rows"),
            "matches": F.col("source_rows") == F.col("target_rows"),
        }
    )


def positional_mismatches(
    source: DataFrame, target: DataFrame, value: str = "event_time", order: str = "seq", by: Sequence[str] = ()
) -> DataFrame:
    """Target rows whose value differs from the source's at the same position.

    A target position the source does not have counts as a mismatch.
    """
    src = dense_position(source.select(*by, order, value), "position", order, by).select(
        *by, "position", F.col(value).alias("_source_value"), F.lit(True).alias("_found")
    )
    tgt = dense_position(target.select(*by, order, value), "position", order, by)
    paired = tgt.join(src, [*by, "position"], "left")
    same = F.col("_found").isNotNull() & F.col(value).eqNullSafe(F.col("_source_value"))
    return paired.filter(~same).select(*by, order, "position", value, "_source_value")


def positional_mismatch_rate(
    source: DataFrame, target: DataFrame, value: str = "event_time", order: str = "seq"
) -> DataFrame:
    """One row: mismatches, source rows and their ratio (0 for an empty source)."""
    bad = positional_mismatches(source, target, value, order).agg(
        F.count("*").alias("mismatches"), F.lit(0).cast("bigint").alias("source_rows")
    )
    rows = source.agg(F.lit(0).cast("bigint").alias("mismatches"), F.count("*").alias("source_rows"))
    return (
        bad.unionByName(rows)
        .agg(F.sum("mismatches").alias("mismatches"), F.sum("source_rows").alias("source_rows"))
        .withColumn(
            "mismatch_rate",
            F.col("mismatches").cast("double") / F.greatest(F.lit(1), F.col("source_rows")).cast("double"),
        )
    )


def arrival_disorder(
    df: DataFrame, value: str = "event_time", order: str = "seq", key: Sequence[str] = ()
) -> DataFrame:
    """Per key: rows, and rows whose value is before that of the row arriving just ahead.

    The window runs over blocks of the arrival order, never over a whole key, so a key
    that holds a third of the table is split; the seams between blocks are compared in a
    second pass over one row per key and block. Rows without an arrival number have no
    place and are left out.
    """
    arrived = df.select(*key, order, value).filter(F.col(order).isNotNull())
    block = arrived.withColumn("_block", F.shiftright(F.col(order).cast("bigint"), BLOCK_BITS))
    inside = Window.partitionBy(*key, "_block").orderBy(order)
    early = F.lag(value).over(inside) > F.col(value)
    per_block = (
        block.withColumn("_early", F.coalesce(early, F.lit(False)))
        .groupBy(*key, "_block")
        .agg(
            F.count("*").alias("_rows"),
            F.count_if("_early").alias("_inner"),
            F.min_by(value, order).alias("_first"),
            F.max_by(value, order).alias("_last"),
        )
    )
    # Seams: the blocks are cut again, twice, so these windows are bounded as well.
    upper = per_block
    for level in ("_super", "_top"):
        below = "_block" if level == "_super" else "_super"
        cut = upper.withColumn(level, F.shiftright(below, SUPER_BITS))
        upper = _over_seams(cut, Window.partitionBy(*key, level).orderBy(below), [*key, level], below)
    whole = _over_seams(upper, Window.partitionBy(*key).orderBy("_top"), list(key), "_top")
    return whole.select(*key, F.col("_rows").alias("rows"), F.col("_inner").alias("out_of_order"))


def _over_seams(parts: DataFrame, order: WindowSpec, keys: Sequence[str], place: str) -> DataFrame:
    """Parts of one whole put together: their counts and one more for each seam with a later value before it."""
    seam = F.coalesce(F.lag("_last").over(order) > F.col("_first"), F.lit(False))
    return (
        parts.withColumn("_seam", seam)
        .groupBy(*keys)
        .agg(
            F.sum("_rows").alias("_rows"),
            (F.sum("_inner") + F.count_if("_seam")).alias("_inner"),
            F.min_by("_first", place).alias("_first"),
            F.max_by("_last", place).alias("_last"),
        )
    )


def inversions(df: DataFrame, value: str, order: str = "seq", by: Sequence[str] = ()) -> DataFrame:
    """How disordered the rows are: pairs whose earlier row has the greater value, exactly, per group.

    Values are integers, and replaced by their ranks; an inverted pair is one whose ranks first differ, from the highest bit down, in a
    bit that the earlier row has and the later has not. So for each bit, among rows that agree in the bits above it, the
    rows with the bit before each row without it are counted. Groups of at most 2^14 rows are counted where one shuffle of
    their rows leaves them; only rows of larger groups are shuffled once per bit, as differences of two positions, in one pass
    of block-wise prefix sums. No window holds more than 2^18 rows or counts. Rows that share value or order value are not
    inverted; rows without a value, an order value or a group have no place.
    """
    there = F.col(order).isNotNull() & F.col(value).isNotNull()
    rows = df.groupBy(*by).agg(F.count_if(there).alias("rows"))
    placed = df.filter(there).select(*by, F.col(order).alias("_order"), F.col(value).cast("bigint").alias("_value"))
    placed = placed.dropna(subset=list(by)) if by else placed
    if by:
        # At most one row per 2**14 rows of the table.
        large = F.broadcast(rows.filter(F.col("rows") > SMALL_GROUP_ROWS).select(*by))
        pairs = _pairs_in_small_groups(placed.join(large, list(by), "left_anti"), by).unionByName(
            _pairs_in_blocks(placed.join(large, list(by), "left_semi"), by)
        )
    else:
        pairs = _pairs_in_blocks(placed, by)
    joined = rows.unionByName(pairs, allowMissingColumns=True).groupBy(*by)
    return joined.agg(F.max("rows").alias("rows"), F.coalesce(F.max("inversions"), F.lit(0)).alias("inversions"))


def _pairs_in_small_groups(placed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inverted pairs per group: every window and the sum stay in the partition of the group."""
    whole = Window.partitionBy(*by)
    ranked = placed.withColumn("_rank", F.dense_rank().over(whole.orderBy("_value")) - 1)
    # A group has as many bits as its own highest rank.
    highest = ranked.withColumn("_highest", F.max("_rank").over(whole)).filter(F.col("_highest") > 0)
    bits = F.sequence(F.lit(0), F.length(F.bin("_highest")) - 1)
    upto = Window.partitionBy(*by, "_bit", "_group").orderBy("_order", "_value").rowsBetween(Window.unboundedPreceding, 0)
    before = _by_bit(highest, bits, by).withColumn("_ones", F.sum("_one").over(upto))
    return before.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_one") == 0, F.col("_ones"))), F.lit(0)).alias("inversions"))


def _pairs_in_blocks(placed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inverted pairs per group, whatever its size: rows times bits are shuffled by blocks of the order."""
    values = placed.select(*by, "_value").distinct()
    ranked = placed.join(dense_positions(values, {"_rank": "true"}, "_value", by), [*by, "_value"])
    # No rank has more bits than the number of different values of a group.
    most = values.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.coalesce(F.max("_n"), F.lit(0))).scalar()
    bits = F.sequence(F.lit(0), F.floor(F.log2(most + 1)).cast("int"))
    counted = dense_positions(
        _by_bit(ranked, bits, by), {"_all": "true", "_zeros": "_one = 0"}, "_order", [*by, "_bit", "_group"]
    )
    pairs = F.coalesce(F.sum(F.when(F.col("_one") == 0, F.col("_all") - F.col("_zeros"))), F.lit(0))
    return counted.groupBy(*by).agg(pairs.alias("inversions"))


def _by_bit(ranked: DataFrame, bits: Column, by: Sequence[str]) -> DataFrame:
    """Each row once per bit, with the bits above it and the bit itself."""
    return ranked.select(*by, "_order", "_value", "_rank", F.explode(bits).alias("_bit")).select(
        *by,
        "_order",
        "_value",
        "_bit",
        F.expr("_rank >> (_bit + 1)").alias("_group"),
        F.expr("(_rank >> _bit) & 1").alias("_one"),
    )


def referential_check(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """One row: parents without children and child rows without a parent."""
    counts = side_counts(
        parent.select(F.col(parent_key).alias("_key")), child.select(F.col(child_key).alias("_key")), ["_key"]
    )
    childless = F.count_if((F.col("source_rows") > 0) & (F.col("target_rows") == 0))
    orphans = F.coalesce(F.sum(F.when(F.col("source_rows") == 0, F.col("target_rows"))), F.lit(0))
    return counts.agg(
        childless.alias("parents_without_children"),
        orphans.alias("orphan_rows"),
        ((childless == 0) & (orphans == 0)).alias("consistent"),
    )
