"""Main text of web pages: a linear-chain conditional random field over leaf blocks of the document tree.

A page becomes a chain of leaf blocks, the runs of text between block-level tags, each with its ancestors. Ancestor tags,
words of their classes, roles and ids, and the form of the text are the features; Viterbi decoding labels the chain. The
field is trained on generated, labelled pages (``PAGES``, fixed seed), for no labelled pages exist.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Container, Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.common import table, text_blocks
from tallyward.llm.crf import forward_backward, viterbi

PAGES = 700
ROUNDS = 160
SEED = 6

# No attempt runs past the next "<" in vain; tags it does not match are read by _tag_end.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^<\"]*+\"|'[^<']*+')*+>)?",
    re.S,
)
_STOP = re.compile("[>\"']")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN, _UNSEEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)"), re.compile(r"display\s*:\s*none")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
# Fixed sets of HTML: elements whose content is no text, elements without content, inline elements.
_SILENT = frozenset("script style noscript template title textarea select option button svg canvas iframe object audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
# An opening tag of the key's group ends an open element of the same group, as browsers do.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPES = frozenset("ul ol dl table article section div body aside nav form main header footer blockquote".split())


def _hides(attributes: str) -> bool:
    """Whether an element with these attributes is not shown."""
    low = attributes.lower()
    if "hidden" in low and _HIDDEN.search(_QUOTED.sub('""', low)):
        return True
    return "none" in low and bool(_UNSEEN.search(low))


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Where the tag ends whose attributes start at ``at``: behind the next ">" outside quotes, or the next at all; -1 if none.

    A quote from which no such end was found is remembered in ``dead``, so a page is not read again for each of its tags.
    """
    seen, place = [], at
    while (m := _STOP.search(page, place)) and m.start() not in dead:
        if m[0] == ">":
            return m.end()
        seen.append(m.start())
        place = page.find(m[0], m.end()) + 1
        if not place:
            break
    dead.update(seen)
    return page.find(">", at) + 1 or -1


def blocks_of(page: str, known: Container[str] | None = None) -> list[tuple[str, list[tuple[str, str]], int]]:
    """(text, ancestors as (tag, words of class, id and role), characters inside links) of each leaf block, in order.

    Ancestors are distinct, the innermost last; with ``known``, only those with features in it and the innermost. Text of
    hidden elements and of controls is no block and ends none. However deep or broken, a page takes time in proportion to
    its length, times the distinct ancestors of a block.
    """
    out: list[tuple[str, list[tuple[str, str]], int]] = []
    stack: list[tuple[str, str, bool]] = []
    distinct: list[tuple[str, str]] = []
    times: Counter[tuple[str, str]] = Counter()
    is_open: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = at = hidden = 0
    inline_hidden: list[str] = []
    dead: set[int] = set()
    endless: set[str] = set()
    last = page.rfind(">")
    ancestors: list[tuple[str, str]] | None = None

    def flush() -> None:
        nonlocal linked, ancestors
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                if ancestors is None:
                    ancestors = [x for x in distinct if x != stack[-1][:2]] + [x[:2] for x in stack[-1:]]
                out.append((text, ancestors, min(linked, len(text))))
            parts.clear()
        linked = 0

    def cut(place: int) -> None:
        nonlocal hidden, ancestors
        for tag, named, was_hidden in reversed(stack[place:]):
            is_open[tag] -= 1
            hidden -= was_hidden
            times[tag, named] -= 1
            if not times[tag, named]:
                del times[tag, named]
                if distinct and distinct[-1] == (tag, named):
                    distinct.pop()
        del stack[place:]
        ancestors = None

    while True:
        m = _MARKUP.search(page, at)
        if m and m[2] and m.start() > last:
            # No tag can end any more, so all that follows is text but for comments.
            m = _COMMENT.search(page, m.start())
        text = page[at : m.start()] if m else page[at:]
        if text and not hidden and not inline_hidden:
            parts.append(text)
            linked += len(text.strip()) if links else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower() if m.re is _MARKUP else ""
        if not tag:
            continue
        if m[3] is None:
            start, at = at, _tag_end(page, at, dead)
            attributes = page[start : at - 1]
        else:
            attributes = m[3][:-1]
        closing = m[1]
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
        if not closing and tag in _SILENT:
            end = None if tag in endless else _closing(tag).search(page, at)
            if end is None:
                endless.add(tag)
            if end or tag in ("script", "style"):
                at = end.end() if end else len(page)
            if tag in _APART:
                flush()
            continue
        if tag in _INLINE:
            if inline_hidden and closing and tag == inline_hidden[-1]:
                inline_hidden.pop()
            elif not closing and tag not in _VOID and (inline_hidden[-1:] == [tag] or _hides(attributes)):
                inline_hidden.append(tag)
            continue
        flush()
        links = 0
        inline_hidden.clear()
        if closing:
            if is_open[tag]:
                place = len(stack) - 1
                while stack[place][0] != tag:
                    place -= 1
                cut(place)
        elif tag not in _VOID:
            shut = _CLOSES.get(tag, ())
            if tag not in _CLOSES and stack and stack[-1][0] == "p":
                cut(len(stack) - 1)
            if any(is_open[x] for x in shut):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in shut:
                        cut(i)
                        break
                    if stack[i][0] in _SCOPES:
                        break
            named = " ".join(a or b or c for _, a, b, c in _NAMED.findall(attributes)).lower() if attributes else ""
            unseen = _hides(attributes)
            names = " ".join(w for w in _PART.findall(named) if known is None or "is=" + w in known)
            if not times[tag, names] and (known is None or names or "in=" + tag in known):
                distinct.append((tag, names))
            times[tag, names] += 1
            stack.append((tag, names, unseen))
            is_open[tag] += 1
            hidden += unseen
            ancestors = None
    flush()
    return out


@cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}(?![a-zA-Z0-9-])[^>]*+>", re.I)


_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
# Silent elements between blocks; the others stand inside a line.
_APART = frozenset("title template noscript iframe".split())


# Words that speak of page furniture, in the languages of the corpus.
FURNITURE = frozenset(
    "copyright cookie cookies subscribe login newsletter privacy advertisement sponsored share comments reply impressum datenschutz".split()
)


def features(text: str, ancestors: list[tuple[str, str]], linked: int, place: int, n: int) -> list[str]:
    words = text.split()
    k = len(words)
    out = [
        f"len={min(6, k.bit_length())}",
        f"link={min(3, 4 * linked // max(1, len(text)))}",
        f"stop={min(3, sum(w[-1] in '.!?' for w in words))}",
        f"comma={min(2, text.count(','))}",
        f"end={text[-1] in '.!?:'}",
        f"copy={'©' in text}",
        f"word={any(w.lower().strip('.,:!?') in FURNITURE for w in words[:12])}",
        f"tag={ancestors[-1][0] if ancestors else ''}",
    ]
    for tag, named in ancestors:
        out.append("in=" + tag)
        out += ["is=" + w for w in named.split()]
    return list(dict.fromkeys(out))


def training_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """Generated pages and the labels of their leaf blocks (1: main text)."""
    rng = random.Random(seed)
    pick, chance = rng.choice, rng.random

    def words(low: int, high: int) -> str:
        made = ["".join(pick(("the", "er", "on", "in", "la", "ung", "es", "ti", "que", "re")) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high))]
        for i in range(len(made)):
            made[i] += "," if chance() < 0.08 else "." if chance() < 0.1 else ""
        return " ".join(made).capitalize() + pick((".", ".", ".", "", "!"))

    out = []
    for _ in range(n):
        html: list[str] = []
        labels: list[int] = []

        def block(text: str, label: int, before: str = "", after: str = "") -> None:
            html.append(f"{before}{text}{after}")
            labels.append(label)

        def links(tag: str, label: int = 0) -> None:
            for _ in range(rng.randint(3, 7)):
                block(f'<a href="/x">{words(1, 2).rstrip(".!")}</a>', label, f"<{tag}>", f"</{tag}>")

        def within(opening: str, closing: str, fill) -> None:
            html.append(opening)
            fill()
            html.append(closing)

        def named(tag: str, *names: str) -> tuple[str, str]:
            how = pick(("class", "id", "class"))
            return f'<{tag} {how}="{pick(names)}">', f"</{tag}>"

        def menu() -> None:
            opening, closing = pick((("<nav>", "</nav>"), named("div", "menu", "nav", "navbar", "breadcrumb", "navigation", "topnav"), named("ul", "menu", "nav", "tabs")))
            within(opening, closing, lambda: links("li"))

        def some(low: int, high: int, words_low: int, words_high: int, tag: str = "p") -> None:
            for _ in range(rng.randint(low, high)):
                block(words(words_low, words_high), 0, f"<{tag}>", f"</{tag}>")

        def advert() -> None:
            opening, closing = named("div", "ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-box")
            within(opening, closing, lambda: block(words(4, 30), 0, *pick((("", ""), ("<p>", "</p>")))))

        def notice() -> None:
            opening, closing = named(pick(("div", "section", "aside")), "cookie", "cookie-notice", "notice", "consent", "alert", "popup", "newsletter", "subscribe", "disclaimer")
            within(opening, closing, lambda: some(1, 2, 5, 30))

        def sidebar() -> None:
            opening, closing = pick((("<aside>", "</aside>"), named("div", "sidebar", "side", "widget", "related", "recommended", "related-posts", "share", "social", "tags"), named("aside", "sidebar", "related")))
            within(opening, closing, lambda: (block(words(1, 3), 0, "<h3>", "</h3>"), pick((lambda: links("li"), lambda: some(1, 3, 6, 35)))()))

        def form() -> None:
            within("<form>", "</form>", lambda: some(1, 3, 1, 12, pick(("p", "div", "fieldset"))))

        def comments() -> None:
            opening, closing = named(pick(("div", "section", "ol", "ul")), "comments", "comment-list", "commentlist", "comment", "responses", "discussion", "replies", "disqus")

            def fill() -> None:
                if chance() < 0.5:
                    block(words(1, 3), 0, "<h3>", "</h3>")
                for _ in range(rng.randint(1, 4)):
                    block(words(5, 60), 0, *pick((("<p>", "</p>"), ("<li>", "</li>"), ('<div class="comment-body">', "</div>"))))

            within(opening, closing, fill)

        def header() -> None:
            opening, closing = pick((("<header>", "</header>"), named("div", "header", "masthead", "top", "site-header")))
            within(opening, closing, lambda: (block(words(1, 4), 0, "<div>", "</div>"), menu() if chance() < 0.5 else None))

        def footer() -> None:
            opening, closing = pick((("<footer>", "</footer>"), named("div", "footer", "foot", "copyright", "site-footer", "legal")))
            block_text = pick(("&copy; ", "© 2024 ", "Copyright ", "")) + words(2, 25)
            within(opening, closing, lambda: (block(block_text, 0, *pick((("", ""), ("<p>", "</p>")))), links("li") if chance() < 0.3 else None))

        def furniture() -> None:
            """What the tag alone, or a rare name with a telling part, sets apart from the text around it."""
            opening, closing = pick((("<nav>", "</nav>"), ("<aside>", "</aside>"), ("<form>", "</form>"), ("<footer>", "</footer>"),
                                     named("div", "disqus_thread", "user-feedback", "reader-comments", "feedback", "thread", "pager")))
            fill = pick((lambda: block(words(1, 12), 0), lambda: some(1, 3, 2, 40), lambda: links(pick(("li", "div", "p")))))
            if opening == "<form>":
                fill = lambda: some(1, 2, 1, 12, pick(("p", "div", "fieldset")))
            within(opening, closing, fill)

        def article() -> None:
            plain = chance() < 0.12
            opening, closing = pick((("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("<article>", "</article>"),
                                     named("div", "content", "post", "article", "entry", "main", "story", "post-content", "article-body", "text")))
            if plain:
                opening, closing = "<div>", "</div>"

            def fill() -> None:
                if chance() < 0.8:
                    block(words(2, 12), 1, "<h1>", "</h1>")
                for _ in range(rng.randint(1, 14)):
                    kind = chance()
                    if kind < 0.72:
                        block(words(1, 8) if chance() < 0.3 else words(8, 90), 1, "<p>", pick(("</p>", "</p>", "")))
                    elif kind < 0.79:
                        block(words(2, 8), 1, "<h2>", "</h2>")
                    elif kind < 0.85:
                        within("<ul>", "</ul>", lambda: [block(words(2, 20), 1, "<li>", "</li>") for _ in range(rng.randint(2, 4))])
                    elif kind < 0.88:
                        block(words(5, 40), 1, "<blockquote>", "</blockquote>")
                    elif kind < 0.91:
                        within("<table><tr>", "</tr></table>", lambda: [block(words(1, 3), 1, "<td>", "</td>") for _ in range(3)])
                    elif kind < 0.925 and not plain:
                        advert()
                    elif kind < 0.94 and not plain:
                        sidebar()
                    elif kind < 0.99 and not plain:
                        furniture()
                    else:
                        block(words(3, 12), 1, "<p>", "</p>")
                if chance() < 0.1 and not plain:
                    comments()

            within(opening, closing, fill)

        for part, often in ((header, 0.5), (menu, 0.7), (notice, 0.3), (advert, 0.4), (sidebar, 0.2), (article, 0.97), (sidebar, 0.4),
                            (form, 0.3), (comments, 0.4), (advert, 0.2), (notice, 0.15), (footer, 0.8)):
            if chance() < often:
                part()
        out.append((f"<html><body>{''.join(html)}</body></html>", labels))
    return out


@cache
def trained() -> tuple[dict[str, float], list[list[float]]]:
    """Weights of features and transitions, by gradient ascent on the likelihood of the generated pages."""
    names: dict[str, int] = {}
    chains, gold_labels = [], []
    for page, labels in training_pages():
        found = blocks_of(page)
        if len(found) == len(labels) and found:
            chains.append([[names.setdefault(f, len(names)) for f in features(*b, i, len(found))] for i, b in enumerate(found)])
            gold_labels.append(labels)
    steps = max(map(len, chains))
    y = np.zeros((len(chains), steps), int)
    valid = np.zeros((len(chains), steps), bool)
    rows, cells = [], []
    for c, (chain, labels) in enumerate(zip(chains, gold_labels)):
        y[c, : len(labels)] = labels
        valid[c, : len(labels)] = True
        for t, active in enumerate(chain):
            rows += active
            cells += [c * steps + t] * len(active)
    rows, cells = np.array(rows), np.array(cells)
    both = valid[:, 1:]
    gold = np.array([[((y[:, :-1] == j) & (y[:, 1:] == k) & both).sum() for k in (0, 1)] for j in (0, 1)], float)
    theta, trans = np.zeros(len(names)), np.zeros((2, 2))
    mean, var = np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    for t in range(1, ROUNDS + 1):
        unary = np.bincount(cells, theta[rows], y.size).reshape(y.shape)
        marginal, moves, _ = forward_backward(np.where(valid, unary, np.nan), trans)
        gap = np.where(valid, y - marginal, 0).ravel()
        grad = np.concatenate([np.bincount(rows, gap[cells], len(names)) - 0.5 * theta, (gold - moves.sum(0)).ravel() - trans.ravel()])
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        step = 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-3)
        theta, trans = theta + step[:-4], trans + step[-4:].reshape(2, 2)
    return {f: float(theta[i]) for f, i in names.items()}, trans.tolist()


def main_text(page: str, model) -> str:
    weights, trans = model
    found = blocks_of(page, weights)
    get = weights.get
    unary = [sum(get(f, 0.0) for f in features(*b, i, len(found))) for i, b in enumerate(found)]
    return "\n".join(b[0] for b, label in zip(found, viterbi(unary, trans)) if label)


def extract(pages: DataFrame) -> DataFrame:
    """The main text of whole pages.

    pages: page_id, url, html; other columns are ignored. One row per page: page_id, url, text (blocks in page order, one a
    line; empty if there are none), n_chars. A null or empty page has an empty text; repeated rows are kept; an empty
    table gives no rows. Markup that is cut off or never closed is read as browsers do, as far as text goes.
    """
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run_pages in text_blocks(batch.column(2)):
                texts = [main_text(p, model) for p in run_pages]
                ids, urls = (batch.column(k).slice(first, len(texts)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [ids, urls, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    narrow = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
