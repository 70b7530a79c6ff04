"""Comparison of id sets by invertible Bloom lookup tables.

A sketch is a table of fixed size into which each id is added at three cells; sketches of parts are summed, and the target's
is subtracted from the source's, which leaves the differing ids alone. As long as these are fewer than about three quarters
of the cells they can be peeled off one by one. So a comparison of any number of ids moves a few thousand numbers per task,
instead of all ids, if the sides hardly differ; if they differ more, ``reconcile`` answers.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.operators.reconcile import side_counts

HASHES = 3
# Cells of a sketch: bounds what is collected.
CELLS = 3 * 2048


def _words(key: int) -> list[int]:
    """Four independent numbers of 32 bits: three places and a check. The frame side takes the same from md5."""
    digest = hashlib.md5(str(key).encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def sketch(df: DataFrame, key: str, sign: int = 1, cells: int = CELLS) -> DataFrame:
    """(cell, n, key_sum, check_sum) of a bigint id column; null ids are left out. Sums merge by adding."""
    width = cells // HASHES
    ids = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("_id"))
    ids = ids.withColumn("_digest", F.md5(F.col("_id").cast("string")))
    words = [F.conv(F.substring("_digest", 8 * j + 1, 8), 16, 10).cast("bigint") for j in range(HASHES + 1)]
    spots = F.array(*[(F.lit(j * width) + words[j] % width).cast("int") for j in range(HASHES)])
    wide = "decimal(38,0)"
    return (
        ids.select(F.explode(spots).alias("cell"), "_id", words[HASHES].alias("_check"))
        .groupBy("cell")
        .agg(
            (F.count("*") * sign).alias("n"),
            (F.sum(F.col("_id").cast(wide)) * sign).cast(wide).alias("key_sum"),
            (F.sum(F.col("_check").cast(wide)) * sign).cast(wide).alias("check_sum"),
        )
    )


def difference(source: DataFrame, target: DataFrame, key: str, cells: int = CELLS) -> DataFrame:
    """The sketch of the source less that of the target."""
    both = sketch(source, key, 1, cells).unionByName(sketch(target, key, -1, cells))
    return both.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "key_sum", "check_sum")])


def peeled(difference_rows: list[tuple], cells: int = CELLS) -> dict[int, int] | None:
    """Surplus of the source per differing id, from the cells (cell, n, key_sum, check_sum); None if some stay entangled."""
    width = cells // HASHES
    table = {c: [n, int(k), int(h)] for c, n, k, h in difference_rows if n or k or h}
    out: dict[int, int] = {}
    todo = list(table)
    while todo:
        n, total, check = table.get(cell := todo.pop(), (0, 0, 0))
        if n == 0 or total % n:
            continue
        one = total // n
        *places, own = _words(one)
        if own * n != check:
            continue
        out[one] = out.get(one, 0) + n
        for j in range(HASHES):
            spot = j * width + places[j] % width
            held = table.setdefault(spot, [0, 0, 0])
            held[0] -= n
            held[1] -= total
            held[2] -= check
            todo.append(spot)
    if any(any(v) for v in table.values()):
        return None
    return {k: n for k, n in out.items() if n}


def differing_ids(source: DataFrame, target: DataFrame, key: str, cells: int = CELLS) -> DataFrame:
    """(id, side) of ids that only one side has: ``missing`` in the target, or ``unexpected`` there.

    The sketch is evaluated here; its size is fixed. An id that both sides have, but not equally often, comes out of it as
    well, so what was peeled, at most ``cells`` ids, is looked up on both sides. Where the sides differ too much to be
    peeled, all ids are compared.
    """
    found = peeled([tuple(r) for r in difference(source, target, key, cells).collect()], cells)
    sides = [df.select(F.col(key).cast("bigint").alias("id")).filter("id IS NOT NULL") for df in (source, target)]
    if found is not None:
        if not found:
            return sides[0].filter("false").select("id", F.lit("").alias("side"))
        # At most as many rows as there are cells.
        few = F.broadcast(source.sparkSession.createDataFrame([(i,) for i in found], "id bigint"))
        sides = [side.join(few, "id", "left_semi") for side in sides]
    counts = side_counts(*sides, ["id"])
    side = F.when(F.col("target_rows") == 0, "missing").when(F.col("source_rows") == 0, "unexpected")
    return counts.select("id", side.alias("side")).filter("side IS NOT NULL")
