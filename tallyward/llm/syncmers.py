"""Document fingerprints from closed syncmers.

A k-mer of code points is chosen where the least of the hashes of its inner s-mers is the first or the last of them.
The choice looks at nothing but the k-mer, so an edit changes only the anchors that overlap it, and equal passages have
equal anchors at any place. The fingerprint of a text is all its anchors with their positions. Two texts are matched by
position: of the anchors they share, those that follow each other in the same order in both count.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyward.llm.common import BLOCK_CHARS, mix, span_hashes, staged, table, text_blocks

K, S = 16, 8


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position, hash) of every closed syncmer, by text and position."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = _code_points("".join(texts))
    n = len(points) - K + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.uint64)
    starts = np.arange(len(points) - S + 1)
    inner = span_hashes(points, starts, starts + S)
    window = K - S
    least = inner[:n].copy()
    for i in range(1, window + 1):
        np.minimum(least, inner[i : i + n], out=least)
    ends = np.cumsum(sizes)
    chosen = np.flatnonzero((inner[:n] == least) | (inner[window : window + n] == least))
    owner = np.searchsorted(ends, chosen, side="right")
    inside = chosen + K <= ends[owner]
    chosen, owner = chosen[inside], owner[inside]
    return owner, chosen - (ends - sizes)[owner], span_hashes(points, chosen, chosen + K)


Anchors = tuple[np.ndarray, np.ndarray]  # positions and hashes, by position


def fingerprint(texts: list[str]) -> list[Anchors]:
    """All anchors of each text. A text without any has one at 0, the hash of the whole; an empty one has none."""
    owner, position, hashes = anchors(texts)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(texts):
        own = slice(cuts[i], cuts[i + 1])
        if cuts[i] == cuts[i + 1] and text:
            points = _code_points(text)
            out.append((np.zeros(1, np.int64), span_hashes(points, np.array([0]), np.array([len(points)]))))
        else:
            out.append((position[own], hashes[own]))
    return out


def _by_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors sorted by hash and then position, and how many of its hash come before each."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    return order, np.arange(len(ranked)) - starts[np.cumsum(new) - 1]


def matches(a: Anchors, b: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """Places in both fingerprints of anchors with equal hashes, by place in the first: the n-th of a hash with the n-th."""
    if not len(a[1]) or not len(b[1]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    (first, again), (second, again_b) = _by_hash(a[1]), _by_hash(b[1])
    # A hash and its count, mixed into one number.
    left = a[1][first] + mix(again.astype(np.uint64))
    right = b[1][second] + mix(again_b.astype(np.uint64))
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    i, j = first[i], second[j]
    order = np.argsort(i)
    return i[order], j[order]


def longest_run(places: np.ndarray) -> int:
    """Length of the longest increasing run of places, not necessarily of neighbours."""
    if len(places) < 2 or (places[1:] > places[:-1]).all():
        return len(places)
    piles: list[int] = []
    for p in places.tolist():
        at = bisect_left(piles, p)
        piles[at : at + 1] = [p]
    return len(piles)


def likeness(a: Anchors, b: Anchors) -> float:
    """Anchors matched in the same order in both, as a share of all anchors of both; 1 for two empty fingerprints."""
    n, m = len(a[1]), len(b[1])
    if not n and not m:
        return 1.0
    common = longest_run(matches(a, b)[1])
    return common / (n + m - common)


def packed(marks: Anchors) -> bytes:
    """A fingerprint as bytes: position (8) and hash (8) of each anchor, little-endian."""
    return np.stack([marks[0].astype("<u8"), marks[1].astype("<u8")], axis=1).tobytes()


def _digest(marks: Anchors) -> str:
    return hashlib.sha256(packed(marks)).hexdigest() if len(marks[1]) else ""


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (binary, see ``packed``) of whole texts (null: empty), one row per document; other columns are
    ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch.column(1)):
                marks = pa.array([packed(m) for m in fingerprint(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), marks], ["doc_id", "fingerprint"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fingerprint binary")


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, n_anchors long"
)
_LOWEST = -(1 << 63)


def _compared(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    """Results of (doc_id, text, text of the next document); the next text of a row is mostly the text of the next row."""
    ids, own, nxt = zip(*rows)
    changed = [edited(a, b) for a, b in zip(own, nxt)]
    marks, changed_marks = fingerprint(list(own)), fingerprint(changed)
    strange = [i for i in range(len(own)) if i + 1 == len(own) or nxt[i] is not own[i + 1]]
    follow = dict(zip(strange, fingerprint([nxt[i] for i in strange])))
    columns = [
        pa.array([None if i == _LOWEST else i for i in ids], pa.int64()),
        pa.array(map(len, own), pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        pa.array([_digest(m) for m in marks]),
        pa.array([_digest(m) for m in changed_marks]),
        pa.array([likeness(a, b) for a, b in zip(marks, changed_marks)], pa.float64()),
        pa.array([likeness(m, follow[i] if i in follow else marks[i + 1]) for i, m in enumerate(marks)], pa.float64()),
        pa.array([len(m[1]) for m in marks], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])


_SEAM = "part int, first boolean, seam_id long, seam_text string"


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text and its edited text, whose last half comes from the next document.

    docs: doc_id, text; other columns are ignored. Documents follow each other by descending doc_id (rows with one
    doc_id: by descending hash of their text; null ids last), the first follows the last; a single document follows
    itself. A null text is empty. One row per document: doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint
    (digests of all anchors with their positions), near_edited, near_next (share of anchors matched in order) and n_anchors.
    Texts shorter than a k-mer have their own hash as only anchor, empty ones an empty fingerprint; two empty ones have
    likeness 1. An empty table gives no rows.

    Rows are range-partitioned by id and hash, so that equal and null ids spread as well; texts are shuffled once. Each
    partition compares its neighbours and leaves its first and last row for the comparison across the seams.
    """
    narrow = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("hash", F.sha2("text", 256))
    order = [F.desc("doc_id"), F.desc("hash")]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    names = [c.split()[0] for c in f"{RESULT}, {_SEAM}".split(", ")]
    width = len(RESULT.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        types = [f.type for f in _compared([(0, "", "")]).schema] + [pa.int32(), pa.bool_(), pa.int64(), pa.string()]

        def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
            nothing = [pa.nulls(batch.num_rows, t) for t in types[width:]]
            return pa.RecordBatch.from_arrays([*batch.columns, *nothing], names)

        def seam(first: bool, row: tuple[int, str]) -> pa.RecordBatch:
            values = [None] * width + [part, first, *row]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        held, rows, size = None, [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, texts in text_blocks(batch.column(1)):
                for row in zip(ids[low:], texts):
                    if held is None:
                        yield seam(True, row)
                    else:
                        rows.append((*held, row[1]))
                        size += len(held[1])
                    held = row
                    if size > BLOCK_CHARS:
                        yield whole(_compared(rows))
                        rows, size = [], 0
        if rows:
            yield whole(_compared(rows))
        if held is not None:
            yield seam(False, held)

    # Results, which are small, and two texts a partition.
    found = staged(ordered.mapInArrow(run, f"{RESULT}, {_SEAM}"), "fingerprints")
    results = found.where("part is null").select(*names[:width])
    seams = found.where("part is not null")
    parts = seams.where("first").select("part")
    # One number for each partition.
    after = Window.orderBy("part")
    every = after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("part", F.coalesce(F.lead("part").over(after), F.min("part").over(every)).alias("next_part"))
    heads = seams.where("first").select(F.col("part").alias("next_part"), F.col("seam_text").alias("next_text"))
    ends = seams.where("not first").join(parts, "part").join(heads, "next_part").select("seam_id", "seam_text", "next_text")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _compared([tuple(c[0].as_py() for c in batch.slice(i, 1).columns)])

    return results.unionByName(ends.mapInArrow(across, RESULT))


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    return compare(table(spark, sf_dir, "documents"))
