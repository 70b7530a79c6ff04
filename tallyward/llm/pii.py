"""Personal data: spans found by rule, and spans that boosted trees pick from generous candidates.

The base spans follow fixed patterns and checks and always stay. Generators with high recall propose more, overlapping
spans: numbers in other notations and spelled-out addresses. Boosted trees judge a candidate by its format and by the
words around it; a threshold per kind, calibrated on examples the trees have not seen, decides. Trees and thresholds
come from generated examples (``EXAMPLES`` a kind, fixed seed), for no labelled spans exist.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import boosting
from tallyward.llm.common import table, text_blocks

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 1000
RUN = 4096
PRECISION = 0.98
SEED = 20
CONTEXT = 40

# Fixed patterns of the base spans. The look-behinds and possessive repeats only spare useless attempts.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the longest run of local characters that no earlier match holds, and a domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        done = match.end() if match else at + 1
        if match:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the spans found by rule, by start, then kind."""
    found = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: ?[\[({] ?at ?[\])}] ?| at )[A-Za-z0-9-]{1,63}"
                 r"(?:(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,4}")
_GROUP = re.compile(r"[0-9]+")
# What may stand between the digit groups of one number, at most three of them.
_BETWEEN = frozenset(" ()./_-\u00a0")
GROUPS, DIGITS = 6, {"phone": (7, 15), "card": (12, 19)}
_V6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_ENDING = re.compile(r"\W(com|org|net|edu|info|io|de|fr|es)$")
_WORD = re.compile(r"[a-z]+")
# Words that speak for a kind, and words that speak against all of them.
CUES = {
    "email": ("mail", "email", "contact", "write", "reach", "correo", "courriel", "schreiben"),
    "ip": ("ip", "host", "server", "client", "login", "address", "network", "remote"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta", "cvv"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "telephone", "telefono", "whatsapp"),
}
AGAINST = ("order", "isbn", "invoice", "version", "date", "id", "ref", "serial", "item", "sku", "page", "time",
           "number", "code", "ticket", "build", "license", "doi", "lot")


Span = tuple[str, int, int]


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the places that spans cover, disjoint and ascending."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _free(start: int, end: int, covered: tuple[list[int], list[int]]) -> bool:
    i = bisect_left(covered[0], end)
    return i == 0 or covered[1][i - 1] <= start


def _numbers(text: str, covered: tuple[list[int], list[int]]) -> Iterator[Span]:
    """Every run of up to ``GROUPS`` digit groups outside base spans that has the digits of a phone or a card.

    Groups follow one another over at most three separators. A run starts and ends next to no letter or digit; a plus or an
    opening bracket before it is part of it. A start has at most ``GROUPS`` runs, so their number grows with the text.
    """
    groups: list[tuple[int, int]] = []
    for m in _GROUP.finditer(text):
        a, b = m.span()
        if not _free(a, b, covered):
            groups = []
            continue
        if groups and not (a - groups[-1][1] <= 3 and _BETWEEN.issuperset(text[groups[-1][1] : a])):
            groups = []
        groups = [*groups[1 - GROUPS :], (a, b)]
        if text[b : b + 1].isalnum():
            continue
        digits = 0
        for c, d in reversed(groups):
            digits += d - c
            if digits > DIGITS["card"][1]:
                break
            if text[c - 1 : c].isalnum() or digits < DIGITS["phone"][0]:
                continue
            while c and text[c - 1] in "+(" and _free(c - 1, b, covered):
                c -= 1
            for kind, (low, high) in DIGITS.items():
                if low <= digits <= high:
                    yield kind, c, b


def candidates(text: str, base: list[Span] | None = None) -> Iterator[Span]:
    """Spans that may be personal data beyond the base ones, none of which they touch; they overlap one another."""
    covered = _merged(base_spans(text) if base is None else base)
    found = [_numbers(text, covered)]
    if " at " in text or any(f"{c}at" in text or f"{c} at" in text for c in "[({"):
        found.append(("email", *m.span()) for m in _AT.finditer(text))
    if "::" in text or text.count(":") > 2:
        found.append(("ip", *m.span()) for m in _V6.finditer(text))
    return (c for c in chain.from_iterable(found) if _free(c[1], c[2], covered))


_INSIDE = re.compile(r"[0-9][^0-9]+(?=[0-9])")
_BEFORE = re.compile(r"[0-9]([ ()./_\u00a0-]{1,3})$")
_AFTER = re.compile(r"([ ()./_\u00a0-]{1,3})[0-9]")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span, the words around it, and how numbers next to it are set off."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT // 2]
    d = _digits(span)
    groups = [len(g) for g in _GROUP.findall(span)]
    seps = [c for c in span if not c.isalnum()]
    left = _WORD.findall(before.lower())
    near = left[-3:] + _WORD.findall(after.lower())[:1]
    inside = {m[0][1:] for m in _INSIDE.finditer(span)}
    ahead, behind = _BEFORE.search(before), _AFTER.match(after)
    at = span.find(" at ")
    local = span[:at] if at > 0 else ""
    return [
        *(float(kind == k) for k in KINDS),
        len(span), len(d), len(groups), max(groups, default=0), min(groups, default=0), groups[-1] if groups else 0,
        groups[0] if groups else 0, groups[1] if len(groups) > 1 else 0,
        len(seps), len(set(seps)), span.count("-"), span.count("."), span.count("/"), span.count("("), span.count(":"),
        float(luhn(d)) if d else -1.0,
        len(set(d)), float(d[:1] == "0"), float(d[:1] in tuple("3456")), float(d[:2] in ("19", "20")), float(span[0] == "+"),
        float(span.count("(") == span.count(")")),
        *(float(any(w in CUES[k] for w in near)) for k in KINDS),
        float(any(w in AGAINST for w in near)),
        float(before[-1:] in ("=", "#", "/", "$", ":", '"')), float(after[:1] in ("/", "%", '"', ":")),
        float("[" in span or "(at" in span or "{" in span), float(" dot " in span), float(bool(_ENDING.search(span))),
        float(at > 0), float(any(not c.isalpha() for c in local)),
        float(groups[:3] == [3, 3, 4]), float(len(set(groups[:4])) == 1 and len(groups) >= 4),
        0.0 if ahead is None else 1.0 + (ahead[1] in inside), 0.0 if behind is None else 1.0 + (behind[1] in inside),
    ]


def examples(n: int = EXAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, labels and kinds of generated candidates: personal data in other notations, and lookalikes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("the", "ra", "ent", "lo", "is", "mi", "and", "er")) for _ in range(rng.randint(1, 3)))  # noqa: E731,E501
    num = lambda k: "".join(str(rng.randint(0, 9)) for _ in range(k))

    def card(sep: str) -> str:
        body = rng.choice("3456") + num(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def positive(kind: str) -> str:
        if kind == "email":
            name = f"{word()}{rng.choice('._-')}{word()}" if rng.random() < 0.6 else f"{word()}{num(2)}"
            at, dot = rng.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), ("{at}", "."),
                                  (" at ", ".")))
            if rng.random() < 0.3 and (at, dot) != (" at ", "."):
                name = word()
            return f"{name}{at}{word()}{dot}{rng.choice(('com', 'org', 'net', 'de'))}"
        if kind == "ip":
            return ":".join("%x" % rng.randint(0, 65535) for _ in range(8)) if rng.random() < 0.6 else f"2001:db8::{rng.randint(1, 65535):x}:{rng.randint(1, 65535):x}"  # noqa: E501
        if kind == "card":
            return card(rng.choice((".", "/", "_", "  ", " - ")))
        return rng.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}",
                           f"{num(3)} {num(3)} {num(4)}", f"({num(3)}){num(3)}-{num(4)}", f"({num(3)}) {num(3)} {num(4)}",
                           f"00{num(2)} {num(3)} {num(7)}", f"0{num(3)} / {num(7)}", f"0{num(2)}/{num(7)}",
                           f"0{num(2)} {num(4)} {num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"))

    def negative(kind: str) -> str:
        if kind == "email":
            site = f"{word()}.{rng.choice(('com', 'org', 'net', 'de', 'io'))}"
            return rng.choice((f"{word()} at {word()}.{word().title()}", f"{word()} at {word()} dot {word()}",
                               f"{word()} at {site}", f"{word().title()} at {site}", f"{word()} at www.{site}"))
        if kind == "ip":
            return f"{rng.randint(0, 23):02d}:{num(2)}:{num(2)}" if rng.random() < 0.8 else f"{num(1)}:{num(1)}:{num(1)}"
        if kind == "card":
            return rng.choice((num(13), num(16), num(19), f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(8)}-{num(4)}",
                               ".".join(num(4) for _ in range(4)), f"{num(4)} {num(4)} {num(4)} {num(4)}"))
        return rng.choice((day(), f"{day()} {day()}", num(8), num(10), num(13), f"{num(4)}.{num(4)}", f"{num(3)}, {num(4)}",
                           f"20{num(2)}-20{num(2)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(16)}",
                           f"{num(3)} {num(3)} {num(3)}", " ".join(num(rng.randint(1, 5)) for _ in range(rng.randint(3, 8))),
                           f"{num(2)}.{num(2)} {num(2)}.{num(2)} {num(2)}.{num(2)}", f"{day()} {num(2)}.{num(2)}.{num(2)}"))

    def day() -> str:
        y, m, d = f"{rng.choice((19, 20))}{num(2)}", f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 28):02d}"
        return rng.choice((f"{y}-{m}-{d}", f"{y}/{m}/{d}", f"{d}.{m}.{y}", f"{m}/{d}/{y}", f"{y}{m}{d}"))

    def neighbour() -> str:
        return rng.choice((day(), num(1), num(2), num(3), num(4), f"{num(1)}.{num(1)}", f"{num(2)}/{num(2)}"))

    rows, labels, kinds = [], [], []
    for kind in KINDS:
        for i in range(n):
            good = i % 2 == 0
            cue = rng.random()
            lead = rng.choice(CUES[kind]) if cue < (0.5 if good else 0.05) else rng.choice(AGAINST) if cue > (0.99 if good else 0.5) else word()  # noqa: E731,E501
            mark = rng.choice(("", "", ":")) if good else rng.choice(("", "", ":", "="))
            text, planted = f"{word()} {word()} {lead}{mark} ", set()
            # Numbers stand beside one another: a neighbour before, after, or a second one of the kind.
            beside = kind in ("card", "phone") and rng.random() < 0.5
            if beside and rng.random() < 0.5:
                text += f"{neighbour()} "
            for again in range(1 + (beside and rng.random() < 0.5)):
                text += " " * again + (made := positive(kind) if good else negative(kind))
                if good:
                    planted.add((kind, len(text) - len(made), len(text)))
            if beside and rng.random() < 0.5:
                text += f" {neighbour()}"
            text += f" {word()}, {word()}."
            for span in candidates(text):
                rows.append(features(text, *span))
                labels.append(float(span in planted))
                kinds.append(span[0])
    return np.array(rows), np.array(labels), kinds


@cache
def trained():
    """The trees, and for each kind the score down to which unseen examples are right ``PRECISION`` of the time."""
    x, y, kinds = examples()
    fold = np.arange(len(y)) % 3 == 0
    model = boosting.fit(x[~fold], y[~fold], trees=40)
    score, cut = boosting.predict(model, x[fold]), {}
    for kind in KINDS:
        own = np.array([k == kind for k in kinds])[fold]
        s, t = score[own], y[fold][own]
        order = np.argsort(-s, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero((right >= PRECISION) & (t[order] == 1))
        cut[kind] = 1.1
        if len(good):
            # Halfway from the last right one to the next score below it.
            lower = s[s < s[order][good[-1]]]
            cut[kind] = float(s[order][good[-1]] + lower.max(initial=0)) / 2
    return model, cut


def all_spans(text: str, base: list[Span], model) -> list[Span]:
    """Base spans and the candidates that the trees accept: best score first, none that overlaps one taken before."""
    trees, cut = model
    accepted = []
    # Judged in runs, so that a text full of numbers holds the features of one run alone.
    for run in batched(candidates(text, base), RUN):
        scores = boosting.predict(trees, np.array([features(text, *c) for c in run]))
        accepted += [(-s, *c) for s, c in zip(scores.tolist(), run) if s >= cut[c[0]]]
    if not accepted:
        return base
    starts: list[int] = []
    ends: list[int] = []
    taken = list(base)
    for _, kind, start, end in sorted(accepted, key=lambda c: (c[0], _order(c[1:]))):
        i = bisect_left(starts, end)
        if i == 0 or ends[i - 1] <= start:
            starts.insert(i, start)
            ends.insert(i, end)
            taken.append((kind, start, end))
    return sorted(taken, key=_order)


def find(docs: DataFrame) -> DataFrame:
    """Personal data in whole texts.

    docs: doc_id, text; other columns are ignored. One row per document: doc_id, base and spans, both arrays of
    (kind, start, end) in code points by start, then kind. A null or empty text has none; each row is judged alone, so
    repeated ids and rows are kept; an empty table gives no rows.
    """
    model = trained()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            for first, texts in text_blocks(batch.column(1)):
                base = [base_spans(t) for t in texts]
                every = [all_spans(t, b, model) for t, b in zip(texts, base)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array(map(as_rows, base), kind),
                        pa.array(map(as_rows, every), kind),
                    ],
                    ["doc_id", "base", "spans"],
                )

    kind = "array<struct<kind: string, start: long, end: long>>"
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(scan, f"doc_id long, base {kind}, spans {kind}")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; where spans overlap, the first's kind stands for all."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with all spans replaced in ``text`` and, where there is such a column, ``n_chars`` counted anew.

    All rows and columns stay, in their order and types; a null text stays null.
    """
    model, names = trained(), docs.columns

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, run in text_blocks(whole.column(names.index("text"))):
                batch = whole.slice(first, len(run))
                nulls = batch.column(names.index("text")).is_null().to_pylist()
                texts = [None if null else redacted(t, all_spans(t, base_spans(t), model)) for t, null in zip(run, nulls)]
                columns = dict(zip(names, batch.columns))
                columns["text"] = pa.array(texts, columns["text"].type)
                if "n_chars" in columns:
                    counts = [n if t is None else len(t) for t, n in zip(texts, columns["n_chars"].to_pylist())]
                    columns["n_chars"] = pa.array(counts, columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return docs.mapInArrow(replace, docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, with counts and a digest of the base spans."""
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    return found.select(
        "doc_id", *(count(k) for k in KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )
