"""Fill-in-the-middle texts by secondary sort.

Texts are cut into pieces, runs of tokens of a bounded size, each with its place in the output. One shuffle by document
and one sort by place bring the pieces into output order (``repartition`` and ``sortWithinPartitions``, the frame's
``repartitionAndSortWithinPartitions``); they stream into digests piece by piece, so no whole text is held. To restore a
text, the markers are looked for in the stream of output pieces, each stretch gets its place in the text, and the pieces
are sorted once more within their partition.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.common import table, text_blocks

PIECE_UNITS = 4096
PIECE_CHARS = 65_536
BATCH_CHARS = 1_000_000
SEED = 42
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT, SPM_PERCENT = 50, 80

_SOLID = re.compile(r"[^\x20\x09-\x0D]+")
_MARKER = re.compile("<[PSM]>")
_RANK = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

KEY = ["part", "hash", "copy"]
PIECES = (
    "part int, hash long, copy int, place int, at long, piece string, "
    "doc_id long, n long, form string, prefix_chars long, middle_chars long"
)
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def _batches(rows: Iterator[tuple], schema: str, text: int) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``BATCH_CHARS`` characters in column ``text``."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*held), kinds)], list(names))

    for row in rows:
        held.append(row)
        size += len(row[text] or "") + 100
        if size > BATCH_CHARS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch], most: int = 1024) -> Iterator[tuple]:
    for batch in batches:
        for first in range(0, batch.num_rows, most):
            yield from zip(*(c.to_pylist() for c in batch.slice(first, most).columns))


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers from the hash of the id; a null id is an empty text there."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def unit_ends(text: str) -> list[int]:
    """Where each token of a text ends: white space and the word behind it, or white space at the end."""
    ends = [m.end() for m in _SOLID.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return ends


def cut(text: str, doc_id: int | None, seed: int = SEED) -> tuple[int, str, list[int], int, int]:
    """(tokens, form, their ends, tokens before the middle, tokens before the suffix)."""
    ends = unit_ends(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    a, b = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    if not text or _MARKER.search(text) or h3 % 100 >= FIM_PERCENT:
        return len(ends), "plain", ends, 0, 0
    return len(ends), "spm" if h4 % 100 < SPM_PERCENT else "psm", ends, a, b


def _chunks(text: str, ends: list[int], low: int, high: int, head: str) -> Iterator[str]:
    """Tokens low .. high - 1 as pieces of at most PIECE_UNITS tokens and about PIECE_CHARS characters, after ``head``."""
    start = ends[low - 1] if low else 0
    while True:
        upto = min(low + PIECE_UNITS, high)
        stop = ends[upto - 1] if upto > low else start
        for at in range(start, max(stop, start + 1), PIECE_CHARS):
            yield head + text[at : min(at + PIECE_CHARS, stop)]
            head = ""
        low, start = upto, stop
        if low >= high:
            return


def cut_pieces(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The pieces of all outputs, in no order: key (part, hash, copy), place (1), at, piece.

    The first piece of a document (at 0) carries its doc_id, n, form, prefix_chars and middle_chars. The key names a row
    of ``docs``: its partition, the hash of its id and text, and a number among equal ones there, so that a task that
    runs again gives equal keys in whatever order its rows come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        copies: Counter[int] = Counter()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for first, texts in text_blocks(batch.column(1)):
                    for doc_id, text in zip(ids[first:], texts):
                        digest = hashlib.blake2b(f"{doc_id}:{text}".encode(), digest_size=8).digest()
                        name = int.from_bytes(digest, "big", signed=True)
                        copy = copies[name]
                        copies[name] += 1
                        n, form, ends, a, b = cut(text, doc_id, seed)
                        if form == "plain":
                            spans, lengths = [("", 0, n)], (None, None)
                        else:
                            spans = [(PREFIX, 0, a), (SUFFIX, b, n), (MIDDLE, a, b)]
                            if form == "spm":
                                spans[:2] = spans[1::-1]
                            p, m = (ends[i - 1] if i else 0 for i in (a, b))
                            lengths = (p, m - p)
                        about, at = (doc_id, n, form, *lengths), 0
                        for head, low, high in spans:
                            for piece in _chunks(text, ends, low, high, head):
                                yield (part, name, copy, 1, at, piece, *about)
                                about, at = (None,) * 5, at + 1

        yield from _batches(rows(), PIECES, 5)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, PIECES)


def in_output_order(pieces: DataFrame) -> DataFrame:
    """Pieces by document and place: the one shuffle."""
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "place", "at")


def texts(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The output of every document as one text, from the same stream: doc_id, n, form, prefix_chars, middle_chars, output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            about, held = None, []
            for row in _rows(batches):
                if row[4] == 0:
                    if about:
                        yield (*about, "".join(held))
                    about, held = row[6:11], []
                held.append(row[5])
            if about:
                yield (*about, "".join(held))

        yield from _batches(rows(), OUTPUT, 5)

    return in_output_order(cut_pieces(docs, seed)).mapInArrow(run, OUTPUT)


OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
BACK = PIECES + ", output_sha256 string"
DIGESTS = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
)


class _Restorer:
    """Tells, from a stream of output pieces, which stretch of the text each belongs to."""

    def __init__(self, form: str):
        self.rank, self.tail, self.plain = 0, "", form == "plain"

    def feed(self, piece: str) -> Iterator[tuple[int, str]]:
        """(rank of the stretch, characters), in the order of the output; two characters are held back for the next."""
        if self.plain:
            yield 0, piece
            return
        piece, at = self.tail + piece, 0
        for m in _MARKER.finditer(piece):
            yield self.rank, piece[at : m.start()]
            self.rank, at = _RANK[m[0]], m.end()
        keep = max(at, len(piece) - 2)
        yield self.rank, piece[at:keep]
        self.tail = piece[keep:]

    def close(self) -> Iterator[tuple[int, str]]:
        yield self.rank, self.tail


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces in output order: the digest of each output (place -1), and the pieces with their place in the text."""

    def rows() -> Iterator[tuple]:
        about, key, digest, back, at = None, None, None, None, 0
        nothing = (None,) * 6

        def end() -> Iterator[tuple]:
            nonlocal at
            for rank, piece in back.close():
                yield (*key, rank, at, piece, *nothing)
                at += 1
            yield (*key, -1, 0, None, *about, digest.hexdigest())

        for row in _rows(batches):
            if row[4] == 0:
                if about:
                    yield from end()
                key, about, digest, at = row[:3], row[6:11], hashlib.sha256(), 0
                back = _Restorer(about[2])
            digest.update(row[5].encode())
            for rank, piece in back.feed(row[5]):
                if piece:
                    yield (*key, rank, at, piece, *nothing)
                    at += 1
        if about:
            yield from end()

    yield from _batches(rows(), BACK, 5)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces in the order of the text, each document's digests."""

    def rows() -> Iterator[tuple]:
        about, digest = None, None
        for row in _rows(batches):
            if row[3] == -1:
                if about:
                    yield (*about, digest.hexdigest())
                about, digest = row[6:12], hashlib.sha256()
            else:
                digest.update(row[5].encode())
        if about:
            yield (*about, digest.hexdigest())

    yield from _batches(rows(), DIGESTS, 6)


def restored_pieces(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Pieces in the order of the text, as found in the output: the key, place (-1: the digest of the output), at, piece."""
    found = in_output_order(cut_pieces(docs, seed)).mapInArrow(_restored, BACK)
    return found.sortWithinPartitions(*KEY, "place", "at")  # the partitions are those of the shuffle


def digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Rearrange every text for filling in its middle, and take it back from what came out.

    docs: doc_id, text; other columns are ignored. One row per row of ``docs``: doc_id, n (tokens), form, prefix_chars,
    middle_chars (null if plain), output_sha256, restored_sha256 (of the text rebuilt from output and form). A null text is
    empty, and an empty one plain; so is a text that holds a marker. A null id draws by the empty id; rows with one id,
    and repeated rows, are documents of their own. A very long text is one stream of pieces of bounded size, in one
    task, as its digest must be. An empty table gives no rows. ``texts`` gives the outputs themselves.
    """
    return restored_pieces(docs, seed).mapInArrow(_digested, DIGESTS)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and digests of the rearranged and of the restored texts of all documents."""
    return digests(table(spark, sf_dir, "documents"))
