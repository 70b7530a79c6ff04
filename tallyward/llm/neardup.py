"""Near duplicates by SuperMinHash: banding for candidates, full sets for links, union-find for groups.

Equal sets of shingles become one node first. A signature takes, for each element, a random permutation of the slots, so
that ranks of one element never share a slot; slots fill fast, and a text of many words stops after a few ranks. With
``BANDS`` bands of ``ROWS`` slots, two sets of similarity 0.8 share no band with a chance of about 3 in a million. In a
band's bucket members are first paired with its least member alone. Where buckets still hold more than one component,
members of the others are compared with the whole of the largest one and with each other, chunk by chunk. Every link is confirmed on
the full sets, and no pair is a row unless it is a candidate with a bucket's least member or a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.common import blocks, mix, span_hashes, staged, table
from tallyward.llm.components import components

BANDS, ROWS = 42, 6
SLOTS = BANDS * ROWS
PERCENT = 80
CHUNK, ASKERS = 1024, 256  # followers of one text, and texts that ask about a chunk of a component, in one task
BLOCK = 400_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP, _MASK = 0xD1342543DE82EF95, (1 << 64) - 1
_LOW = np.uint64(0xFFFFFFFF)


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of the distinct word shingles of each text, sorted.

    Words are runs without ASCII white space, A-Z in lower case. A text with fewer words than ``width`` has them all as
    its one shingle, a text without words has none.
    """
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-8", "surrogatepass"), np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts], np.int64)
    solid = np.concatenate([[False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = span_hashes(raw, starts, ends)
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    n = len(words)
    acc = np.zeros(n, np.uint64)
    who, got = [], []
    for i in range(width):
        m = n - i
        acc = mix(acc[:m] + words[i:])
        whole = counts == i + 1 if i + 1 < width else counts >= width
        keep = whole[owner[:m]] & (owner[:m] == owner[i:])
        who.append(owner[:m][keep])
        got.append(acc[keep])
    who, got = np.concatenate(who), np.concatenate(got)
    order = np.lexsort((got, who))
    who, got = who[order], got[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (got[1:] != got[:-1])
    return who[new], got[new]


def super_minhash(owner: np.ndarray, elements: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures [n, slots] of n sets given as (owner, element): the least (rank, fraction) that falls into each slot.

    Each element deals its ranks to the slots in an order of its own (a Fisher-Yates shuffle, one step a rank). A set
    is done once all its slots are filled: later ranks are greater.
    """
    out = np.full(n * slots, _EMPTY)
    live, ids = elements, owner
    dealt = None
    for rank in range(slots):
        draw = mix(live + np.uint64(rank * _STEP & _MASK))
        pick = rank + ((draw & _LOW) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
        if dealt is None:
            slot = pick
        else:
            at = np.arange(len(live))
            slot = dealt[at, pick].astype(np.int64)
            dealt[at, pick] = dealt[:, rank]
        np.minimum.at(out, ids * slots + slot, np.uint64(rank) << np.uint64(32) | draw >> np.uint64(32))
        missing = (out.reshape(n, slots) == _EMPTY).any(1)
        go = missing[ids]
        if not go.any():
            break
        if dealt is None:
            dealt = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (int(go.sum()), 1))
            dealt[np.arange(len(dealt)), pick[go]] = 0
        elif not go.all():
            dealt = dealt[go]
        live, ids = live[go], ids[go]
    return out.reshape(n, slots)


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (size of the set), a, b (128 bits that stand for it), keys (a band each); staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column(1).to_pylist(), BLOCK):
                owner, got = shingles(texts, width)
                n = len(texts)
                sizes = np.bincount(owner, minlength=n)
                full = super_minhash(owner, got, n)
                sums = []
                for salt in (1, 2):
                    s = np.zeros(n, np.uint64)
                    np.add.at(s, owner, mix(got * np.uint64(2) + np.uint64(salt)))
                    sums.append(s.view(np.int64))
                keys = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    keys = mix(keys + full[:, r::ROWS])
                offsets = pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel())),
                    ],
                    ["doc_id", "n", "a", "b", "keys"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(narrow.mapInArrow(run, "doc_id long, n long, a long, b long, keys array<long>"), "signatures")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the distinct pairs u (leading), v whose full sets are alike enough; texts: doc_id, text.

    A leading text goes once to each chunk of its followers; both are compared in one stream.
    """
    followers = texts.join(pairs, texts.doc_id == pairs.v).select(
        "u", F.pmod(F.xxhash64("v"), F.lit(1 << 30)).alias("h"), F.col("v"), "text"
    )
    counts = pairs.groupBy("u").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = followers.join(counts, "u").select("u", F.pmod("h", "chunks").cast("int").alias("chunk"), "v", "text")
    leaders = texts.join(counts, texts.doc_id == counts.u).select(
        "u", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("v"), "text"
    )
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = leaders.unionByName(dealt).repartition(parts, "u", "chunk")
    rows = rows.sortWithinPartitions("u", "chunk", F.col("v").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, held = None, None
        for batch in batches:
            us, vs = [], []
            follower = batch.column(2).to_pylist()
            leading = batch.column(0).to_pylist()
            for first, run_texts in blocks(batch.column(3).to_pylist(), BLOCK):
                owner, got = shingles(run_texts, width)
                cuts = np.searchsorted(owner, np.arange(len(run_texts) + 1))
                for i in range(len(run_texts)):
                    own, u, v = got[cuts[i] : cuts[i + 1]], leading[first + i], follower[first + i]
                    if v is None:
                        lead, held = u, own.copy()
                    elif lead == u:
                        if _alike(held, own, percent):
                            us.append(u)
                            vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return staged(rows.mapInArrow(run, "u long, v long"), "links")


def open_questions(filed: DataFrame, nodes: DataFrame, best: DataFrame) -> DataFrame:
    """node, target: the members of a bucket, and the largest component in it, where the bucket holds others too.

    One row for each member outside the largest component, so a bucket full of one group costs no more than its few other
    members. Buckets of two texts that were compared already are left out.
    """
    sizes = nodes.groupBy("component").agg(F.count("*").alias("size"))
    done = filed.where("n = 2 and node <> least").join(best, (F.col("least") == F.col("u")) & (F.col("node") == F.col("v")))
    placed = filed.select("key", "node").join(done.select("key"), "key", "left_anti").join(nodes, "node")
    placed = placed.join(sizes, "component").select("key", "node", F.struct("size", "component").alias("rank"))
    top = placed.groupBy("key").agg(F.max("rank").alias("top"), F.min("rank").alias("low")).where("low < top")
    asking = placed.join(top, "key").where("rank < top")
    return asking.select("node", F.col("top.component").alias("target")).distinct()


def crossed(questions: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links u, v between a node and any member of its target component or any other node with that target, on full sets.

    Askers meet the others in chunks, so no task holds more than ``ASKERS`` texts, and no pair is a row unless it is a
    link.
    """
    asked = questions.groupBy("target").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("ask_chunks"))
    own = nodes.select("node", F.col("component").alias("target"))
    members = own.union(questions.select("node", "target")).join(asked, "target")
    chunks = members.groupBy("target").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = questions.join(asked, "target").join(chunks, "target").select(
        "target", spread("node", "ask_chunks").alias("i"), every("chunks").alias("j"), F.lit(0).alias("kind"), "node"
    )
    answering = members.join(chunks, "target").select(
        "target", every("ask_chunks").alias("i"), spread("node", "chunks").alias("j"), F.lit(1).alias("kind"), "node"
    )
    meeting = asking.unionByName(answering).join(texts, F.col("node") == texts.doc_id)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = meeting.select("target", "i", "j", "kind", "node", "text").repartition(parts, "target", "i", "j")
    rows = rows.sortWithinPartitions("target", "i", "j", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            kinds, ids = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            us, vs = [], []
            for first, run_texts in blocks(batch.column(5).to_pylist(), BLOCK):
                owner, got = shingles(run_texts, width)
                cuts = np.searchsorted(owner, np.arange(len(run_texts) + 1))
                for i in range(len(run_texts)):
                    own, at = got[cuts[i] : cuts[i + 1]], first + i
                    if places[at] != group:
                        group, held = places[at], []
                    if kinds[at] == 0:
                        held.append((ids[at], own.copy()))
                        continue
                    for node, asker in held:
                        few, many = sorted((len(asker), len(own)))
                        if node != ids[at] and 100 * few >= percent * many and _alike(asker, own, percent):
                            us.append(node)
                            vs.append(ids[at])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return staged(rows.mapInArrow(run, "u long, v long"), "links")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``percent`` or more; empty ones have not."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    union = len(both) - common
    return union > 0 and 100 * common >= percent * union


def _relabel(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after more links between components."""
    named = lambda c, to: nodes.select(F.col("node").alias(c), F.col("component").alias(to))
    between = links.join(named("u", "cu"), "u").join(named("v", "cv"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    grown = components(between).withColumnRenamed("component", "root").withColumnRenamed("node", "component")
    return staged(
        nodes.join(grown, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "nodes"
    )


def group(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """Group documents whose sets of word shingles have a Jaccard similarity of ``percent`` or more, through others too.

    docs: doc_id, text; other columns are ignored. One row per document: doc_id, n_shingles, component_id (the smallest
    doc_id reachable), kept. A text that is null, empty or white space has an empty set and is linked with nothing, as is
    a row whose id is null. Rows with one doc_id are one document: the links of any of its texts are its own. Equal
    rows are kept. An empty table gives no rows.
    """
    base = described(docs, width)
    sets = (
        base.where("n > 0 and doc_id is not null")
        .groupBy("n", "a", "b")
        .agg(F.min(F.struct("doc_id", "keys")).alias("first"))
    )
    sets = staged(sets.select("n", "a", "b", F.col("first.doc_id").alias("node"), "first.keys"), "sets")
    members = sets.select(F.explode("keys").alias("key"), "node")
    buckets = members.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    filed = staged(members.join(buckets, "key"), "buckets")
    stars = filed.where("node <> least").groupBy(F.col("least").alias("u"), F.col("node").alias("v")).agg(F.count("*").alias("bands"))
    stars = staged(stars, "stars")
    wanted = filed.select(F.col("node").alias("doc_id")).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = staged(own.join(wanted, "doc_id", "left_semi"), "candidates")

    # Each text against the bucket leader with which it shares the most bands.
    best = stars.groupBy("v").agg(F.max(F.struct("bands", (-F.col("u")).alias("u"))).alias("best"))
    best = best.select((-F.col("best.u")).alias("u"), "v")
    links = confirmed(best, texts, width, percent)
    linked = components(links)
    nodes = filed.select("node").distinct().join(linked, "node", "left")
    nodes = staged(nodes.select("node", F.coalesce("component", "node").alias("component")), "nodes")

    # What shares a bucket with another component may still be alike to some of it.
    questions = staged(open_questions(filed, nodes, best), "questions")
    if not questions.isEmpty():
        nodes = _relabel(nodes, crossed(questions, nodes, texts, width, percent))

    roots = sets.select("n", "a", "b", "node").join(nodes, "node", "left")
    roots = roots.select("n", "a", "b", F.coalesce("component", "node").alias("component"))
    named_rows = base.select("doc_id", "n", "a", "b").join(roots, ["n", "a", "b"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("doc_id"))
    return named_rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).select(
        "*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in groups by their two-word shingles."""
    return group(table(spark, sf_dir, "documents"), width=2)
