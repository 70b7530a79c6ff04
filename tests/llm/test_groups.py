import itertools
import os
import random
import re
import time

import numpy as np
import pytest
from compare import compare, connect

from tallyward.llm import components, decontaminate, neardup, quotes
from tallyward.llm.queries import llm_oracles, llm_queries

SF = "/root/testdata/sf0.001"


def plain_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain_groups(rows, width):
    sets = [(i, plain_set(t, width)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return {i: find(i) for i in root}


def copies(rng, base, n, rate):
    return [" ".join("".join(rng.choice("abcd") for _ in range(4)) if rng.random() < rate else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("width", [2, 5])
def test_groups(odd, frame, width):
    rng = random.Random(width)
    rows = list(odd[0])
    for k, rate in enumerate((0.0, 0.02, 0.05, 0.08)):
        base = ["".join(rng.choice("efgh") for _ in range(5)) for _ in range(rng.choice((8, 60, 200)))]
        rows += [(1000 * (k + 1) + i, t) for i, t in enumerate(copies(rng, base, 40, rate))]
    got = neardup.group(frame(rows), width).collect()
    want = plain_groups(rows, width)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(plain_set(t, width)) for _, t in rows)
    assert neardup.group(frame([]), width).count() == 0


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    a, b = pool[:1000], pool[500:]
    sig = neardup.super_minhash(np.repeat([0, 1], 1000), np.concatenate([a, b]), 2)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.12
    one = neardup.super_minhash(np.array([0]), a[:1], 1)[0] >> np.uint64(32)
    assert sorted(one.tolist()) == list(range(neardup.SLOTS))  # each rank of an element in a slot of its own


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = components.components(spark.createDataFrame(chain, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(1, 41)} | {103: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


ITEM = "If Anna buys 12 kg of red apples and 5 kg of green pears how many does she carry home to Paris"


def test_templates(odd, frame, spark):
    benchmark = spark.createDataFrame([(1, ITEM, 0), (2, ITEM, 0), (3, None, 0), (4, "", 0), (None, ITEM, 0), (5, "two words", 0)], "item_id long, text string, n int")
    changed = ITEM.replace("Anna", "Bert").replace("12", "40").replace("5", "7").replace("Paris", "Rome")
    torn = ITEM.replace("12 kg", "40 lb")
    rows = [*odd[0], (20, f"before. {ITEM} after"), (21, changed), (22, torn), (23, ITEM[:30]), (24, "here are two words to see"), (20, "again")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(frame(rows), benchmark).collect()}
    # In 22 one unit stands for two: the windows with the rarer value contradict the others and go.
    assert set(got) == {(20, 1), (21, 1), (22, 1), (24, 5)} and got[22, 1].matched < got[22, 1].windows
    assert got[20, 1].changed == 0 and got[21, 1].changed == 4 and got[21, 1].matched == got[21, 1].windows
    assert decontaminate.leaks(frame([]), benchmark).count() == 0
    assert decontaminate.leaks(frame(rows), benchmark.limit(0)).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "user", "What is this?\nSecond line."),
        (1, 1, "assistant", "An answer."),
        (1, 2, "user", "On Monday Ann wrote:\n>  what IS this?\n> > none of these\nA new question."),
        (1, 3, "assistant", "> A new question.\n>> What is this?\nMore."),
        (1, 4, "user", "Thanks."),
        (2, 600, "user", None),
        (2, 0, "user", ""),
        (2, 0, "user", ""),
        (None, None, None, "> lost"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS path")
    got = {(r.conv_id, r.turn): r for r in quotes.reply_ordered(frame).collect()}
    assert [got[1, t].reply_to for t in range(5)] == [None, 0, 0, 2, 3]
    assert [got[1, t].depth for t in range(5)] == [0, 0, 1, 2, 2]
    assert got[1, 2].body == "A new question." and (got[1, 2].n_quoted, got[1, 2].n_linked) == (2, 1)
    assert got[1, 4].path == ".".join(f"{k:012d}" for k in (0, 2, 3))
    assert got[2, 600].reply_to == 0 and quotes.reply_ordered(frame).count() == len(rows)
    assert quotes.reply_ordered(frame.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not there")
@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_against_sql(spark, name):
    assert compare(spark, connect(SF), name, llm_queries()[name], llm_oracles()[name], SF) is None


def plain_matches(docs, items):
    """Brute force over all windows, for texts whose slots do not change."""
    token = re.compile(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*")

    def canonical(w):
        return "<num>" if w[0].isdigit() else "<unit>" if w in decontaminate.UNITS else "<name>" if w[0] != w[0].lower() else w

    out = set()
    for item, text in items:
        words = [canonical(w) for w in token.findall(text)]
        size = min(len(words), decontaminate.WINDOW)
        mine = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        mine = [m for m in mine if sum(w[0] != "<" for w in m) >= min(decontaminate.LITERALS, size)] or mine
        for doc, body in docs:
            there = [canonical(w) for w in token.findall(body or "")]
            held = {tuple(there[i : i + size]) for i in range(len(there) - size + 1)}
            if sum(m in held for m in mine) >= decontaminate.COVERAGE * len(mine):
                out.add((doc, item))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not there")
def test_pipeline(spark):
    """Every stage against a brute-force version on its own input."""
    import corpus_pipeline as pipeline

    from tallyward.llm import packing, pii, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    model = toxicity.fit(docs, labels)
    rows = [(i, t) for i, t in rows if model.score([toxicity.tokens_of(t or "")])[0] < toxicity.THRESHOLD]
    groups = plain_groups(rows, 5)
    rows = [(i, t) for i, t in rows if groups[i] == i]
    leaked = {d for d, _ in plain_matches(rows, items)}
    rows = [(i, t) for i, t in rows if i not in leaked]
    trees = pii.trained()
    rows = {i: pii.redacted(t, pii.all_spans(t, pii.base_spans(t), trees)) for i, t in rows}
    bpe = packing.encoder(packing.vocabulary_path())
    got = pipeline.run(spark, SF).collect()
    sizes = {}
    for r in got:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(bpe.encode_ordinary(t)) + 1 for i, t in rows.items()}
    ends = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(b[:2] == ((a[0], a[1] + a[2]) if a[1] + a[2] < 1024 else (a[0] + 1, 0)) for a, b in zip(ends, ends[1:]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not there")
@pytest.mark.parametrize("odd_rows", [[], [(None, None), (None, "x"), (3, ""), (3, "")]])
def test_stages_take_odd_rows(spark, frame, odd_rows):
    import corpus_pipeline as pipeline

    docs = frame(odd_rows)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == len(odd_rows), name
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == len(odd_rows)


def folded_matches(docs, items):
    """Brute force in any case, for items with literals whose slots do not change but in names."""
    token = re.compile(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*")
    kind = lambda w: "<num>" if w[0].isdigit() else "<unit>" if w.lower() in decontaminate.UNITS else w.lower()
    name = lambda w: not w[0].isdigit() and w not in decontaminate.UNITS and w[0] != w[0].lower()
    out = set()
    for item, text in items:
        words = token.findall(text)
        size = min(len(words), decontaminate.WINDOW)
        cuts = [words[i : i + size] for i in range(len(words) - size + 1)]
        rich = [c for c in cuts if sum(not name(w) and kind(w)[0] != "<" for w in c) >= min(decontaminate.LITERALS, size)]
        for doc, body in docs:
            there = token.findall(body or "")
            held = [there[i : i + size] for i in range(len(there) - size + 1)]
            if rich:
                hits = sum(any(all(name(a) or kind(a) == kind(b) for a, b in zip(c, h)) for h in held) for c in rich)
            else:
                hits = sum(any([w.lower() for w in c] == [w.lower() for w in h] for h in held) for c in cuts)
            if hits >= decontaminate.COVERAGE * len(rich or cuts):
                out.add((doc, item))
    return out


def test_leaks_in_any_case(frame, spark):
    items = [(1, ITEM), (2, "WHO WROTE THIS PLAY OF 5 ACTS"), (3, "a small word list without any capitals or numbers in it")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(10, f"so. {ITEM.upper()} after"), (11, ITEM.lower()), (12, ITEM.lower().replace("anna", "bert")), (13, ITEM.title()),
            (14, "who wrote this play of 5 acts"), (15, "WHO WROTE THAT PLAY OF 6 ACTS"), (16, items[2][1].upper()),
            (17, ITEM.lower().replace("red", "a").replace("green", "b").replace("many", "c")), (18, None), (None, ITEM)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(rows), benchmark).collect()}
    assert got == {(i, k) for i, k in folded_matches(rows, items) if i is not None}
    assert got == {(10, 1), (11, 1), (12, 1), (13, 1), (14, 2), (16, 3)}
    assert decontaminate.leaks(frame([]), benchmark).count() == 0
    assert decontaminate.leaks(frame(rows), benchmark.limit(0)).count() == 0


def test_hostile_documents_are_no_burden(frame, spark):
    """Words between names, a very common word, an item many times over, two texts under one id."""
    items = [(1, ITEM), (2, "the Alpha of Beta in Gamma by Delta"), (3, "Ann Bee Cee Dee Eff Gee Aitch and the"), (4, "end")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "the " * 20_000), (2, f"{ITEM}. " * 1600), (3, "the " * 5000 + "the one of two in three by four"),
            (4, ITEM[:48]), (4, ITEM[48:]), (5, "the of in by " * 3000)]
    start = time.time()
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(rows), benchmark).collect()}
    assert time.time() - start < 120 and got == {(2, 1), (3, 2)} == folded_matches(rows, items)


def test_leaks_with_a_torn_slot(frame, spark):
    twice = "The red box of apples lies on the left side of a wall and below it The blue box of pears lies on the right side"
    rows = [(22, ITEM.replace("12 kg", "40 lb")), (23, twice.replace("The blue", "This blue")), (24, ITEM.replace("kg", "lb", 1)),
            (25, ITEM.replace("of", "on")), (26, ITEM.replace("5 kg", "9 lb").replace("12", "40"))]
    benchmark = spark.createDataFrame([(1, ITEM), (2, twice)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(frame(rows), benchmark).collect()}
    assert set(got) == {(22, 1), (23, 2), (24, 1)}
    # Lost are the windows with the contradicting slot alone: 5 of 15 (all with the 40), in 26 8 of 15.
    assert got[22, 1].windows - got[22, 1].matched == 5 and got[22, 1].changed == 0
