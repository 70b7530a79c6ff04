"""Quality rules, line first: lines that fail go, then documents that lose too much of their text.

A line fails for the first of these rules it breaks: ``symbols`` (marks instead of words), ``navigation`` (short entries
between separators), ``shouting`` (capitals, exclamation marks), ``stutter`` (the same word again and again), ``boilerplate``
(a notice in a short line), ``repeated`` (equal to an earlier line of some length), ``punctuation`` (no sentence ends in it).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.common import table, text_blocks

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
_SEPARATORS = re.compile(r"[|»›•·/>]")
_ENDS = re.compile(r"[.!?…。！？।؟]")
_NOTICE = re.compile(
    r"all rights reserved|privacy policy|terms of (?:use|service)|cookie policy|accept (?:all )?cookies|subscribe to our"
    r"|sign up (?:now|for)|log in|sign in|click here|read more|enable javascript|lorem ipsum"
    r"|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados",
    re.IGNORECASE,
)


@dataclass(frozen=True)
class Rules:
    """Limits. Shares are of a line's words unless said otherwise."""

    symbol_share: float = 0.25  # marks per word
    separators: int = 2
    entry_words: float = 3.0  # words per entry between separators
    capital_share: float = 0.7
    shout_words: int = 4
    stutter_share: float = 0.5  # words equal to the one before
    stutter_words: int = 6
    notice_words: int = 30
    repeat_words: int = 5
    fragment_words: int = 3  # shorter lines may lack a full stop, as headings do
    min_words: int = 50
    repeat_percent: int = 50
    max_lost: float = 0.5  # share of the characters in words


BROKEN = ("symbols", "navigation", "shouting", "stutter", "boilerplate", "repeated", "punctuation")


def symbols(text: str) -> int:
    return sum(map(text.count, _SYMBOLS))


def broken_rule(line: str, words: list[str], seen: bool, rules: Rules) -> str | None:
    """The first rule a line with ``words`` breaks; ``seen``: an equal line came before."""
    n = len(words)
    marks = symbols(line)
    cuts = len(_SEPARATORS.findall(line)) if marks or "/" in line or not line.isascii() else 0
    if cuts >= rules.separators and n - cuts <= rules.entry_words * (cuts + 1):
        return "navigation"
    if marks > rules.symbol_share * n:
        return "symbols"
    # Words in small letters cannot be loud without an exclamation mark.
    if n >= rules.shout_words and ("!" in line or sum(map(str.islower, words)) <= (1 - rules.capital_share) * n):
        loud = sum(1 for w in words if w[-1] == "!" or (len(w) > 1 and w.isupper()))
        if loud >= rules.capital_share * n:
            return "shouting"
    if n >= rules.stutter_words and sum(map(eq, words, words[1:])) >= rules.stutter_share * n:
        return "stutter"
    if n <= rules.notice_words and _NOTICE.search(line):
        return "boilerplate"
    if seen and n >= rules.repeat_words:
        return "repeated"
    if n > rules.fragment_words and not _ENDS.search(line):
        return "punctuation"
    return None


def repeated_words(words: list[str]) -> int:
    """Words in windows of three words that occur twice or more, all occurrences counted."""
    if len(words) < 4:
        return 0
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, group, sizes = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    found = np.flatnonzero(sizes[group] > 1)
    hit = np.zeros(len(words), bool)
    for i in range(3):
        hit[found + i] = True
    return int(hit.sum())


@dataclass
class Cleaned:
    """What is known of a text after cleaning."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    lost_chars: int
    rules: list[str]
    text: str


def clean_text(text: str, rules: Rules) -> Cleaned:
    """Apply the rules to the lines of one text."""
    lines = text.split("\n")
    seen: set[str] = set()
    words: list[str] = []
    left, broken, lost, duplicates = [], [], 0, 0
    for line in lines:
        own = _WORD.findall(line)
        if not own:
            left.append(line)
            continue
        again = line in seen
        seen.add(line)
        duplicates += again
        words += own
        rule = broken_rule(line, own, again, rules)
        if rule:
            broken.append(rule)
            lost += sum(map(len, own))
        else:
            left.append(line)
    n, chars, repeats = len(words), sum(map(len, words)), repeated_words(words)
    failed = n < rules.min_words or 100 * repeats > rules.repeat_percent * n
    return Cleaned(
        n, chars, symbols(text), duplicates, repeats, failed,
        not failed and lost <= rules.max_lost * chars, lost, broken, "\n".join(left),
    )


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, lost_chars long, broken map<string,int>, cleaned string"
)


def clean(docs: DataFrame, rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """Clean every text line by line and judge what is left.

    docs: doc_id, text; other columns are ignored. One row per row of ``docs``: doc_id, the counts of the whole text
    (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), base_failed (too few words, or too many in repeated
    windows), kept, lost_chars (code points of the words in failed lines), broken (failed lines by rule) and, if
    ``with_text``, the cleaned text. A null text is empty, and empty texts fail for want of words; null or repeated ids
    and repeated rows are rows of their own; a text without line breaks is one line, however long. A line that breaks
    several rules counts for the first in the order above, but navigation before symbols. An empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbers = [f.name for f in fields(Cleaned)][:8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch.column(1)):
                out = [clean_text(t, rules) for t in texts]
                counts = [[(r, c.rules.count(r)) for r in BROKEN if r in c.rules] for c in out]
                columns = [
                    batch.column(0).slice(first, len(texts)),
                    *(pa.array([getattr(c, n) for c in out], pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n in numbers),
                    pa.array(counts, pa.map_(pa.string(), pa.int32())),
                    pa.array([c.text if with_text else None for c in out], pa.string()),
                ]
                names = ["doc_id", *numbers, "broken", "cleaned"]
                yield pa.RecordBatch.from_arrays(columns, names)

    out = narrow.mapInArrow(run, SCHEMA)
    return out if with_text else out.drop("cleaned")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the verdict of the rules for all documents."""
    return clean(table(spark, sf_dir, "documents"), with_text=False).drop("broken")
