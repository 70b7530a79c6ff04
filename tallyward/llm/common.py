"""Helpers the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts are handed to numpy in blocks of about this many characters, which bounds a worker's memory
# whatever the number of rows in a batch. A longer text is a block of its own.
BLOCK_CHARS = 1_000_000


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="tallyward-llm-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_dir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, and safe from lost executors.

    Tables lie under ``tallyward-llm/<application>``, to be emptied when the application has ended.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/tallyward-llm/{app}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32(doc_id as text) mod k; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts (null: empty) of about ``limit`` characters, each with the index of its first."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if run and size + len(text) > limit:
            yield first, run
            first, run, size = i, [], 0
        run.append(text)
        size += len(text)
    if run:
        yield first, run


def text_blocks(column: pa.Array, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts (null: empty) of at most ``limit`` bytes or a single text, each with the index of its first.

    Only one run at a time is turned into Python strings.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(column):
        before = int(ends[first - 1]) if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, [t or "" for t in column.slice(first, stop - first).to_pylist()]
        first = stop


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on arrays of unsigned 64-bit numbers."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of an odd base and of its inverse modulo 2^64."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, _INVERSE):
            out = np.ones(size + 1, np.uint64)
            np.multiply.accumulate(np.full(size, np.uint64(base)), out=out[1:])
            both.append(out)
        _powers[size] = (both[0], both[1])
    return _powers[size]


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of symbols[start:end] by prefix sums of a polynomial modulo 2^64, then mixed.

    The hash depends on the symbols alone, not on where the span lies.
    """
    up, down = powers(len(symbols))
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(mix(symbols.astype(np.uint64)) * up[: len(symbols)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
