"""Concatenate and cut: token sequences of fixed length from whole documents.

Pass one tokenises each partition and notes where every document starts within it; the partition totals give, by a
prefix sum, where each partition starts in the one long stream of tokens. Pass two cuts the stream into windows: a
document that crosses a boundary leaves one record on each side. No row is shuffled, only the last sequence has padding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyward.llm.common import blocks, staged, table

LENGTH = 1024
SEPARATOR = 0


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str):
    """A fast encoder for a byte-level BPE vocabulary file whose ids are in the order of its merges.

    ``encode`` with all special tokens allowed yields the ids that ``tokenizers`` yields for the same file,
    ``encode_ordinary`` those with ``encode_special_tokens`` (strings of special tokens are ordinary text), five times as
    fast; tests compare them.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        parsed = json.load(file)
    special = {t["content"]: t["id"] for t in parsed.get("added_tokens", ())}
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {
        bytes(byte_of[c] for c in token): rank
        for token, rank in parsed["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def tokenised(docs: DataFrame, path: str, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, part, start (tokens before it in its partition), n and ids (little-endian, 4 bytes each), staged."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, run in blocks(texts):
                made, starts, sizes = [], [], []
                for text in run:
                    tokens = np.append(np.asarray(bpe.encode_to_numpy(text, allowed_special="all"), "<u4"), np.uint32(separator))
                    made.append(tokens.astype("<u4").tobytes())
                    starts.append(at)
                    sizes.append(len(tokens))
                    at += len(tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(run)),
                        pa.array([part] * len(run), pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(made, pa.binary()),
                    ],
                    ["doc_id", "part", "start", "n", "ids"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = narrow.mapInArrow(encode, "doc_id long, part long, start long, n long, ids binary")
    return staged(out, "tokens")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, separator: int = SEPARATOR) -> DataFrame:
    """Pack documents into sequences of at most ``length`` tokens.

    docs: doc_id, text; other columns are ignored. One row per piece: doc_id, start (ids of the document before the
    piece), length, ids (binary, little-endian unsigned 32-bit), doc_tokens (separator included), sequence_id, offset.
    Every document ends in ``separator``; a null or empty text is the separator alone. Rows with one doc_id (null too)
    are documents of their own; an empty table gives no rows. Order is that of the input's partitions.
    """
    tokens = tokenised(docs, path or vocabulary_path(), separator)
    totals = tokens.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each input partition, whatever the number of documents.
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("at"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in range(7)]
            for doc_id, at, ids in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(ids) // 4
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    row = (doc_id, start, size, ids[4 * start : 4 * (start + size)], n, sequence, offset)
                    for column, value in zip(columns, row):
                        column.append(value)
                    start += size
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return placed.mapInArrow(
        cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def pieces(packed: DataFrame) -> DataFrame:
    """The packed rows with a checksum in place of the ids."""
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pieces(pack(table(spark, sf_dir, "documents")))
