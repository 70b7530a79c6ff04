"""Text quality: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics are computed once for each text and staged; they are narrow. The cosine features approximate a Gaussian
kernel; ridge scores come from normal equations summed over partitions; counts of labels over a grid of raw scores,
from labelled rows left out of the sums, give the calibration. Nothing but these sums comes to the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import calibration
from tallyward.llm.common import fold, staged, table

FEATURES = 256  # cosine features
GAMMA = 0.02
RIDGE = 3.0
SEED = 3
FAN = 16  # partial sums added by one task, and those that reach the driver at most
THRESHOLD = 0.3
CLIP = 5.0
RAW = (-1.0, 2.0)

_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-]")
STATISTICS = 24


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text; zeros for an empty one."""
    words, lines, n = text.split(), text.split("\n"), max(1, len(text))
    k, counts = max(1, len(words)), Counter(words)
    lengths = [len(w) for w in words] or [0]
    top = counts.most_common(3) + [("", 0)] * 3
    pairs = Counter(zip(words, words[1:]))
    mean = sum(lengths) / k
    held = Counter(x.strip() for x in lines if x.strip())
    symbols = Counter(_SYMBOL.findall(text))
    letters = sum(map(str.isalpha, text))
    same = sum(a == b for a, b in zip(words, words[1:]))
    entropy = -sum(c / k * math.log(c / k) for c in counts.values())
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)),
        len(counts) / k, entropy / math.log(k + 1.0) if words else 0.0, top[0][1] / k, (top[0][1] + top[1][1] + top[2][1]) / k,
        max(pairs.values(), default=0) / k, len(pairs) / k, same / k,
        mean, math.sqrt(sum((x - mean) ** 2 for x in lengths) / k), math.log1p(max(lengths)),
        letters / n, sum(map(str.isdigit, text)) / n, sum(map(str.isupper, text)) / n,
        math.sqrt(symbols.total() / n), math.sqrt(max(symbols.values(), default=0) / n), math.sqrt(text.count("|") / n),
        sum(w[:1].isupper() for w in words) / k, sum(w[-1] in ".,;:!?" for w in words) / k,
        math.sqrt((text.count(".") + text.count("!") + text.count("?")) / k),
        1 - len(held) / max(1, held.total()), max(held.values(), default=0) * max(map(len, held), default=0) / n,
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of each text (null: empty), staged."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(narrow.mapInArrow(describe, "doc_id long, x array<double>"), "statistics")


def summed(parts: DataFrame) -> np.ndarray | None:
    """The sum of a column ``s`` of equally long arrays of doubles, one row for each partition that made it.

    Partials are added ``FAN`` at a time, level by level, until so many are left; those are added on the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                s = np.frombuffer(raw)
                total = s.copy() if total is None else total + s
        if total is not None:
            part = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays([part, pa.array([total.tobytes()], pa.binary())], ["part", "s"])

    left = parts.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        parts = parts.repartition(left, F.floor(F.col("part") / FAN)).mapInArrow(add, "part int, s binary")
    rows = parts.select("s").collect()
    return np.sum([np.frombuffer(r.s) for r in rows], axis=0) if rows else None


def partition_sums(df: DataFrame, one) -> np.ndarray | None:
    """The sum over all rows of ``one(x, y)``, which takes a matrix of statistics and a vector of labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                s = one(np.array(batch.column(0).to_pylist(), float), np.array(batch.column(1).to_pylist(), float))
                total = s if total is None else total + s
        if total is not None:
            columns = [pa.array([part], pa.int64()), pa.array([total.ravel().tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "s"])

    return summed(df.select("x", "y").mapInArrow(run, "part long, s binary"))


class Model:
    """Scaling, cosine features, ridge weights and calibration."""

    def __init__(self, dims: int = STATISTICS):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = np.zeros(dims), np.ones(dims)
        self.w = rng.normal(0, math.sqrt(2 * GAMMA), (dims, FEATURES))
        self.b = rng.uniform(0, 2 * math.pi, FEATURES)
        self.weights, self.knots = np.zeros(FEATURES + 1), (np.array([0.0]), np.array([0.5]))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        cosines = math.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b)
        return np.hstack([cosines, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lifted(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return calibration.apply(self.knots, self.raw(x))


def fit(labelled: DataFrame) -> Model:
    """Fit to rows of x, y (0 or 1) and calibrate (boolean: rows for the calibration alone)."""
    model = Model()
    main = labelled.where(~F.col("calibrate"))
    moments = partition_sums(main, lambda x, y: np.vstack([np.full(x.shape[1], len(x)), x.sum(0), (x**2).sum(0)]))
    if moments is None:
        return model
    n, first, second = moments.reshape(3, -1)
    model.mean = first / n
    model.scale = np.sqrt(np.maximum(second / n - model.mean**2, 0)) + 1e-6
    size, lifted, raw = FEATURES + 1, model.lifted, model.raw

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = lifted(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    sums = partition_sums(main, equations).reshape(size, size + 1)
    model.weights = np.linalg.solve(sums[:, :size] + RIDGE * np.eye(size) * FEATURES / 1000, sums[:, size])

    def counts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = calibration.bin_of(raw(x), *RAW)
        return np.vstack([np.bincount(k, minlength=calibration.BINS), np.bincount(k, y, calibration.BINS)])

    cases = partition_sums(labelled.where("calibrate"), counts)
    if cases is None:
        cases = partition_sums(main, counts)
    model.knots = calibration.isotonic(*cases.reshape(2, -1), *RAW)
    return model


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score the quality of whole texts as ``labels.quality`` marks it.

    docs: doc_id, text; labels: doc_id, quality (0 or 1; other values and nulls are left out). Other columns are
    ignored. Rows whose crc32(doc_id) mod 5 is 0 are held out, the quarter with remainder 1 only calibrates. One row per
    document: doc_id, held_out, score, predicted. A null text counts as empty; empty texts are scored like others; null
    ids and repeated rows are scored, each row alone. Without labels every score is 0.5. An empty table gives no rows.
    """
    stats = described(docs)
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
        .where("y in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    key = fold(F.col("doc_id"), 5)
    model = fit(stats.join(marks.where(key != 0), "doc_id").select("x", "y", (key == 1).alias("calibrate")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = model.score(np.array(batch.column(1).to_pylist(), float))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return stats.mapInArrow(score, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(key == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
