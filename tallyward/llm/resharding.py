"""Resharding by minimum-cost flow: equal bytes in the new shards, as few bytes moved as can be.

Documents fall into blocks (old shard, size class, hash slice); there are at most
``old shards x 2 x 64 classes x SLICES`` of them, however many documents there are. A transport problem from old sizes to
new capacities, solved as a minimum-cost flow, says how many bytes go from each old shard to each new one; whole blocks,
largest first, fill these quotas. Only the block table comes to the driver.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyward.llm.common import table

NEW_SHARDS = 16
OLD_SHARDS = 12
SLICES = 64
COPY = "tallyward_copy"


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Units to send from each supplier to each receiver, at the least cost; sums of both must agree.

    Successive shortest paths with potentials over a graph of suppliers and receivers.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # target, room, cost, place of the reverse edge

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost[i][j])
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    potential = [0] * len(graph)
    while True:
        best: list[float] = [float("inf")] * len(graph)
        came: list[tuple[int, int] | None] = [None] * len(graph)
        best[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room and d + price + potential[a] - potential[b] < best[b]:
                    best[b] = d + price + potential[a] - potential[b]
                    came[b] = (a, k)
                    heapq.heappush(heap, (best[b], b))
        if came[sink] is None:
            break
        potential = [p + int(b) if b < float("inf") else p for p, b in zip(potential, best)]
        path, at = [], sink
        while at != source:
            a, k = came[at]
            path.append(graph[a][k])
            at = a
        sent = min(e[1] for e in path)
        for e in path:
            e[1] -= sent
            graph[e[0]][e[3]][1] += sent
    return {
        (i, b - n): graph[b][back][1]
        for i in range(n)
        for b, _, _, back in graph[i]
        if n <= b < n + m and graph[b][back][1]
    }


def place_blocks(sizes: dict[tuple[int, int, int], int], new_shards: int) -> dict[tuple[int, int, int], int]:
    """The new shard of each block (old shard, class, slice), from the bytes of each."""
    total, olds = sum(sizes.values()), sorted({k[0] for k in sizes})
    held = {i: sum(s for k, s in sizes.items() if k[0] == i) for i in olds}
    capacity = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    flow = min_cost_flow(
        [held[i] for i in olds], capacity, [[0 if i == j else 1 for j in range(new_shards)] for i in olds]
    )
    quota = {(olds[i], j): q for (i, j), q in flow.items()}
    room, out, left = list(capacity), {}, []
    ranked = sorted(sizes, key=lambda k: (-sizes[k], k))
    for block in ranked:  # where the flow has room for the whole block, at home first
        options = [j for j in range(new_shards) if quota.get((block[0], j), 0) >= sizes[block] <= room[j]]
        if not options:
            left.append(block)
            continue
        j = min(options, key=lambda x: (x != block[0], -quota[block[0], x], x))
        quota[block[0], j] -= sizes[block]
        room[j] -= sizes[block]
        out[block] = j
    for block in left:  # what fits no quota, largest first into the emptiest shard
        j = max(range(new_shards), key=lambda x: (room[x], x == block[0], -x))
        room[j] -= sizes[block]
        out[block] = j
    return out


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and one more."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def old_shard_by_key(doc_id: Column, shards: int = OLD_SHARDS) -> Column:
    """The layout before, where none is at hand: a hash of the id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % shards


def reshard(docs: DataFrame, old_shard: Column | None = None, new_shards: int = NEW_SHARDS) -> DataFrame:
    """Assign documents to ``new_shards`` shards of near equal bytes, moving as few bytes as possible.

    docs: doc_id, text; other columns are ignored. ``old_shard`` numbers the present shards. One row per document:
    doc_id, size, text_crc32, old_shard, shard, slot (gapless from 0 in each shard, by block, then doc_id). A null
    text has no bytes and the checksum of an empty one; null ids form a slice of their own; rows with one doc_id are
    documents of their own, and equal rows may swap slots. Copies of a text are not held together, for they may
    outweigh a shard. An empty table gives no rows. Shards differ by about the smallest block.
    """
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    text = F.col("text").cast("string")
    old = old_shard_by_key(doc_id) if old_shard is None else old_shard
    narrow = docs.select(
        doc_id.alias("doc_id"),
        size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        old.cast("long").alias("old_shard"),
    ).select(
        "*",
        F.floor(F.log2("size") * 2).cast("int").alias("size_class"),
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLICES)).cast("int").alias("slice"),
    )
    block = ["old_shard", "size_class", "slice"]
    rows = narrow.groupBy(*block).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    shard_of = place_blocks({(r.old_shard, r.size_class, r.slice): r.bytes for r in rows}, new_shards) if rows else {}
    taken: dict[int, int] = defaultdict(int)
    plan = []
    for r in sorted(rows, key=lambda r: (r.old_shard, r.size_class, r.slice)):
        shard = shard_of[r.old_shard, r.size_class, r.slice]
        plan.append((r.old_shard, r.size_class, r.slice, shard, taken[shard]))
        taken[shard] += r.n
    blocks = spark.createDataFrame(plan, "old_shard long, size_class int, slice int, shard int, base long")
    within = Window.partitionBy(*block).orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32")
    # The number of blocks is bounded by the shards, classes and slices, not by the documents.
    return narrow.join(F.broadcast(blocks), block).select(
        "doc_id",
        "size",
        "text_crc32",
        "old_shard",
        "shard",
        (F.col("base") + F.row_number().over(within) - 1).cast("long").alias("slot"),
    )


def rewrite(docs: DataFrame, plan: DataFrame, path: str) -> DataFrame:
    """Write the documents of all shards that lose or gain any, one folder a shard, and return the shards written.

    A shard whose documents all stay, and that gets none, keeps its files. ``plan`` is the result of ``reshard``;
    doc_id must be unique here, as rows are found by it.
    """
    changed = plan.where(F.col("shard") != F.col("old_shard"))
    touched = (
        changed.select(F.explode(F.array(F.col("shard").cast("long"), "old_shard")).alias("shard"))
        .distinct()
        .join(plan.select(F.col("shard").cast("long").alias("shard")).distinct(), "shard", "left_semi")
    )
    moving = plan.join(touched, plan.shard.cast("long") == touched.shard, "left_semi").select("doc_id", "shard")
    moving = moving.withColumnRenamed("shard", COPY)
    docs.join(moving, "doc_id").repartition(COPY, F.pmod(F.xxhash64("doc_id"), F.lit(64))).write.partitionBy(
        COPY
    ).parquet(path)
    return touched


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 of near equal bytes, from 12 shards by a hash of the id."""
    return reshard(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
