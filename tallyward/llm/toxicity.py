"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals make the score of a document.

Only documents are labelled. Tokens of a bounded sample of labelled documents get labels from them: a token is toxic
where its document is and its word, or a beginning of it, is found in toxic documents almost alone. The field over these
tokens uses the word and its beginnings. Documents are chains of ``STEPS`` tokens at a time; forward-backward
marginals are exact within each. The evidence of a document is the sum of their squares; isotonic
calibration on labelled rows that the field has not seen turns it into a score.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import calibration
from tallyward.llm.common import fold, table, text_blocks
from tallyward.llm.crf import chained_marginals, forward_backward

SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000  # labelled documents the field is fitted to, chosen by hash
SAMPLE_CHARS = 20_000  # labelled documents up to this length may be chosen for the fit; all lengths are scored
CALIBRATE = 2000  # labelled documents for the calibration, chosen by hash
STEPS = 64  # tokens of a row: messages pass from row to row of a text; the fit takes rows as pieces
CHAINS = 10_000  # pieces in the fit at most, of the documents above
SHARED = 3  # words that a beginning must have to be a feature
CHANCE, PURITY = 0.01, 0.95
ROUNDS = 40
THRESHOLD, SPAN = 0.3, 0.5
RAW = (-3.0, 6.0)
CACHE = 500_000

_TOKEN = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    return ["=" + word, *("<" + word[:n] for n in (4, 5, 6) if len(word) >= n)]


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def numbered(texts: Iterable[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of texts, their numbers end to end, and the number of tokens of each text."""
    place: dict[str, int] = {}
    flat, sizes = array("i"), array("q")
    for text in texts:
        words = tokens_of(text)
        flat.extend([place.setdefault(w, len(place)) for w in words])
        sizes.append(len(words))
    return list(place), np.array(flat, np.int64), np.array(sizes, np.int64)


def weak_labels(words: list[str], flat: np.ndarray, sizes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words to call toxic: they, or a beginning of four letters or more, are in toxic documents almost alone.

    What counts is distinct neighbourhoods (word before, word after), so copies of a passage count once. A feature needs
    so many of them that chance would hardly put any feature into toxic documents alone that often.
    """
    n = len(words) + 1
    label = np.repeat(toxic, sizes)
    starts = np.cumsum(sizes) - sizes
    before, after = np.roll(flat, 1), np.roll(flat, -1)
    before[starts[sizes > 0]] = n - 1
    after[(starts + sizes - 1)[sizes > 0]] = n - 1
    place = (before * n + flat) * n + after
    clean, bad = (np.bincount(np.unique(place[label == k]) // n % n, minlength=n)[:-1] for k in (False, True))
    share = bad.sum() / max(1, bad.sum() + clean.sum())
    if not 0 < share < 1:
        return np.zeros(len(words), bool)
    # A beginning must stand on more than its most frequent word.
    seen: Counter[str] = Counter()
    top: dict[str, int] = {}
    for k in np.flatnonzero(bad):
        for f in word_features(words[k]):
            seen[f] += int(bad[k])
            if f[0] == "<" and bad[k] > bad[top.setdefault(f, k)]:
                top[f] = k
    least = math.log(len(seen) / CHANCE) / -math.log(share)
    often = {f: [m - (int(bad[top[f]]) if f in top else 0), 0] for f, m in seen.items() if m >= least}
    del seen
    for k in np.flatnonzero(clean):
        for f in word_features(words[k]):
            if f in often and top.get(f) != k:
                often[f][1] += int(clean[k])
    good = {f for f, (m, c) in often.items() if m >= least and m >= PURITY * (m + c)}
    return np.array([bad[k] > 0 and any(f in good for f in word_features(w)) for k, w in enumerate(words)], bool)


def chains(flat: np.ndarray, sizes: np.ndarray, fill) -> tuple[np.ndarray, np.ndarray]:
    """Values of documents, end to end, as rows of ``STEPS`` of one document each, and the document of each row."""
    rows = -(-sizes // STEPS)
    owner = np.repeat(np.arange(len(sizes)), rows)
    out = np.full((len(owner), STEPS), fill, flat.dtype)
    doc_start, row_start = np.cumsum(sizes) - sizes, np.cumsum(rows) - rows
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - doc_start[doc]
    out[row_start[doc] + place // STEPS, place % STEPS] = flat
    return out, owner


class Field:
    """Weights of word features (by name), a bias and transitions."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray):
        self.weights, self.bias, self.trans, self.cache = weights, bias, trans, {}

    def __getstate__(self):
        return self.weights, self.bias, self.trans

    def __setstate__(self, state):
        self.__init__(*state)

    def potential(self, word: str) -> float:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            get = self.weights.get
            got = self.cache[word] = self.bias + sum(get(f, 0.0) for f in word_features(word))
        return got

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of label 1, each text being one chain, in rows of ``STEPS``, and the text of each row."""
        get, of = self.cache.get, self.potential
        flat = np.array([of(w) if (v := get(w)) is None else v for words in texts for w in words], float)
        unary, owner = chains(flat, np.array([len(w) for w in texts], np.int64), np.nan)
        return (chained_marginals(unary, self.trans, owner) if len(unary) else unary), owner

    def evidence(self, texts: list[list[str]]) -> np.ndarray:
        """Log of the summed squares of the marginals in each text: sure tokens count, faint ones hardly add up."""
        marginal, owner = self.marginals(texts)
        total = np.bincount(owner, (marginal**2).sum(1), len(texts)) if len(owner) else np.zeros(len(texts))
        return np.log(total + math.exp(RAW[0]))


def fit_field(texts: list[str], toxic: list[bool]) -> Field:
    """A field fitted to documents by gradient ascent on the likelihood of their weak token labels."""
    words, flat, sizes = numbered(texts)
    label = np.array(toxic, bool)
    bad = weak_labels(words, flat, sizes, label) if len(flat) else np.zeros(0, bool)
    if not bad.any():
        return Field({}, -9.0, np.zeros((2, 2)))
    rows, owner = chains(flat, sizes, -1)
    is_bad = np.append(bad, False)
    has = is_bad[rows].any(1) & label[owner]
    rng = np.random.default_rng(8)
    clean = np.flatnonzero(~label[owner])
    rows = np.vstack([rows[has], rows[rng.permutation(clean)[: max(2000, 2 * int(has.sum()))]]])
    rows = rows[rng.permutation(len(rows))[:CHAINS]]
    labels = is_bad[rows] & (rows >= 0)
    used = np.unique(rows[rows >= 0])
    names: dict[str, int] = {}
    word_at, feature_at = array("i"), array("i")
    # A beginning says something beyond its words only where several words share it.
    shared = Counter(f for w in used for f in word_features(words[w]))
    for k, w in enumerate(used):
        for f in word_features(words[w]):
            if f[0] == "=" or shared[f] >= SHARED:
                word_at.append(k)
                feature_at.append(names.setdefault(f, len(names)))
    word_at, feature_at = np.array(word_at), np.array(feature_at)
    local = np.full(len(words) + 1, len(used))
    local[used] = np.arange(len(used))
    at = local[rows]
    valid, n = rows >= 0, len(rows)
    y = labels.astype(int)
    both = valid[:, 1:]
    gold_moves = np.array([[((y[:, :-1] == j) & (y[:, 1:] == k) & both).sum() for k in (0, 1)] for j in (0, 1)], float)
    gold = np.bincount(at[valid], y[valid], len(used) + 1)[: len(used)]
    theta, trans, bias = np.zeros(len(names)), np.zeros((2, 2)), -3.0
    mean, var = np.zeros(len(names) + 5), np.zeros(len(names) + 5)
    for t in range(1, ROUNDS + 1):
        word_score = np.append(np.bincount(word_at, theta[feature_at], len(used)) + bias, np.nan)
        marginal, moves, _ = forward_backward(word_score[at], trans)
        gap = gold - np.bincount(at[valid], marginal[valid], len(used) + 1)[: len(used)]
        grad = np.concatenate(
            [
                np.bincount(feature_at, gap[word_at], len(names)) - 0.1 * theta,
                (gold_moves - moves.sum(0)).ravel() - 0.1 * trans.ravel(),
                [gap.sum()],
            ]
        )
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        step = 0.2 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-3)
        theta, trans, bias = theta + step[:-5], trans + step[-5:-1].reshape(2, 2), bias + step[-1]
    return Field({f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 0.05}, float(bias), trans)


class Model:
    def __init__(self, field: Field, knots):
        self.field, self.knots = field, knots

    def score(self, texts: list[list[str]]) -> np.ndarray:
        return calibration.apply(self.knots, self.field.evidence(texts))


def _sample(labelled: DataFrame, n: int) -> list:
    """At most n rows, the least by a hash of the id: the same rows whatever the partitions."""
    return labelled.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(n).collect()


def fit(docs: DataFrame, labels: DataFrame, train=None) -> Model:
    """Fit field and calibration to labelled documents; ``train`` is a condition on doc_id (default: the dealt fold).

    At most SAMPLE_TOXIC + SAMPLE_CLEAN labelled documents of up to SAMPLE_CHARS characters, whole, go into the field and
    CALIBRATE others, which it does not see, into the calibration.
    """
    doc_id = F.col("doc_id").cast("long")
    marks = (
        labels.select(doc_id.alias("doc_id"), F.col("toxic").cast("int").alias("y"))
        .where("y in (0, 1) and doc_id is not null")
        .where(fold(F.col("doc_id"), 4) != 2 if train is None else train)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    apart = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0
    wanted = [
        r
        for part, n in (
            (marks.where(~apart & (F.col("y") == 1)), SAMPLE_TOXIC),
            (marks.where(~apart & (F.col("y") == 0)), SAMPLE_CLEAN),
            (marks.where(apart), CALIBRATE),
        )
        for r in _sample(part.select("doc_id", "y", apart.alias("calibrate")), n)
    ]
    neutral = Model(Field({}, -9.0, np.zeros((2, 2))), (np.array([0.0]), np.array([0.0])))
    if not wanted:
        return neutral
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN + CALIBRATE rows.
    picked = docs.sparkSession.createDataFrame([(r.doc_id, r.y, r.calibrate) for r in wanted], "doc_id long, y int, calibrate boolean")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = (
        # Of texts with the same id, the least in binary order.
        docs.select(doc_id.alias("doc_id"), text.alias("text"))
        .where(F.length("text") <= SAMPLE_CHARS)
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("calibrate").alias("calibrate"))
        .collect()
    )
    if not rows:
        return neutral
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    main, rest = [r for r in rows if not r.calibrate], [r for r in rows if r.calibrate]
    field = fit_field([r.text for r in main], [r.y == 1 for r in main])
    rest = rest or main
    raw = np.concatenate([field.evidence([tokens_of(r.text)]) for r in rest])
    k = calibration.bin_of(raw, *RAW)
    y = np.array([r.y for r in rest], float)
    n = np.bincount(k, minlength=calibration.BINS)
    return Model(field, calibration.isotonic(n, np.bincount(k, y, calibration.BINS), *RAW))


def spans(field: Field, text: str) -> list[tuple[int, int]]:
    """Offsets (code points) of runs of tokens whose marginal is at least ``SPAN``."""
    found = list(_TOKEN.finditer(text))
    words = [m[0].lower() for m in found]
    marginal, _ = field.marginals([words])
    out: list[tuple[int, int]] = []
    last = -2
    for i in np.flatnonzero(marginal.ravel()[: len(words)] >= SPAN):
        start, end = found[i].span()
        if i == last + 1:
            start = out.pop()[0]
        out.append((start, end))
        last = i
    return out


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and spans (start, end in code points, end exclusive) of toxic passages of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for first, texts in text_blocks(batch.column(1)):
                scores = model.score([tokens_of(t) for t in texts])
                found = [
                    [{"start": a, "end": b} for a, b in spans(model.field, t)] if s >= THRESHOLD else []
                    for t, s in zip(texts, scores)
                ]
                ids = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(scores, pa.float64()), pa.array(found, kind)], ["doc_id", "score", "spans"]
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long>>")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose score is under the threshold, all columns as they are; no row is shuffled."""
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch.column(at)):
                clean = model.score([tokens_of(t) for t in texts]) < THRESHOLD
                yield batch.slice(first, len(texts)).filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score the toxicity of whole texts as ``labels.toxic`` marks it.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1; other values and nulls are left out). Other columns are ignored.
    Rows whose crc32(doc_id) mod 4 is 2 are held out. One row per document: doc_id, held_out, score, predicted, spans. A
    null text counts as empty; empty texts have no evidence; null ids and repeated rows are scored, each row alone.
    Without labels every score is 0. An empty table gives no rows.
    """
    tagged = tag(docs, fit(docs, labels))
    return tagged.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "spans",
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, with the offending offsets."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
