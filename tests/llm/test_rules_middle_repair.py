import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from tallyward.llm import fill_middle, hirschberg, line_rules, repair

# Quality rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
        n < 50 or 100 * len(hit) > 50 * n,
    )


def test_counts_equal_brute_force(odd):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab\n \t|#é.!\x0b") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += ["a b c a b c", "a a a", "a a a a", "x\ny\nx\n \n \nx", "é🙂 漢 " * 40, *(t or "" for _, t in odd[0])]
    for text in texts:
        c = line_rules.clean_text(text, line_rules.Rules())
        assert (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.base_failed) == plain_counts(text)


def prose(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    return " ".join(" ".join(word() for _ in range(6)).capitalize() + "." for _ in range(n))


GOOD = prose(1, 12)


@pytest.mark.parametrize(
    "line, rule",
    [
        ("Home | About us | Contact | Log in", "navigation"),
        ("Start > Products > Chairs", "navigation"),
        ("Some### words&&& here$$$ and*** more.%%%", "symbols"),
        ("BUY!! THIS!! NOW!! OR!! NEVER!!", "shouting"),
        ("EVERY WORD IS IN CAPITALS HERE.", "shouting"),
        ("spam spam spam spam spam spam spam.", "stutter"),
        ("Subscribe to our newsletter today.", "boilerplate"),
        ("© 2024 Firm. All rights reserved.", "boilerplate"),
        ("A line of words without any end", "punctuation"),
        ("A heading", None),
        ("He said: go! Then he left", None),
        ("The sum of a and b/c is 3 < 4.", None),
        ("NASA and ESA met in Rome.", None),
    ],
)
def test_rules_of_lines(line, rule):
    assert line_rules.broken_rule(line, line.split(), False, line_rules.Rules()) == rule
    cleaned = line_rules.clean_text(f"{GOOD}\n{line}\n{GOOD}", line_rules.Rules())
    assert line not in cleaned.text.split("\n") if rule else line in cleaned.text.split("\n")


def test_documents_that_lose_too_much_go():
    verdict = lambda t: line_rules.clean_text(t, line_rules.Rules()).kept
    menu = "Home | News | Sport | Login\n"
    other = prose(2, 12)
    assert verdict(GOOD) and verdict(f"{GOOD}\n{menu}{other}") and not verdict(menu * 5 + "Text ends here.")
    nav = "\n".join(f"A{i} | B{i} | C{i} | D{i} | E{i} | F{i}" for i in range(60))
    assert not verdict(f"{nav}\n{GOOD}")
    twice = line_rules.clean_text(f"{GOOD}\n{GOOD}", line_rules.Rules())
    assert twice.rules == ["repeated"] and twice.text == GOOD and twice.base_failed
    assert line_rules.clean_text("", line_rules.Rules()).rules == []


def test_clean_frame(odd):
    rows, docs = odd
    got = line_rules.clean(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(
        (str(i), c[0], c[3], c[4], c[5]) for i, c in ((i, plain_counts(t)) for i, t in rows)
    )
    assert not any(r.kept for r in got if r.base_failed) and line_rules.clean(docs.limit(0)).count() == 0
    assert "cleaned" not in line_rules.clean(docs, with_text=False).columns


# Fill in the middle


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    spm = h[3] % 100 < 80
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), out


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_fill_middle_equals_brute_force(frame, odd, monkeypatch):
    rng = random.Random(8)
    make = lambda: "".join(rng.choice("ab é🙂\n\t <>PSM") for _ in range(rng.randint(0, 300)))
    rows = [(i, make()) for i in range(300)] + odd[0] + [(400 + i, f"x <{c}> y") for i, c in enumerate("PSM")]
    rows += [(500 + i, "word" * 50_000 + " end") for i in range(4)] + [(600 + i, " \n" * 40_000) for i in range(4)]
    wanted = [plain_middle(i, t) for i, t in rows]
    assert {w[2] for w in wanted} == {"plain", "psm", "spm"}
    key = lambda r: tuple(map(str, r))
    digests = sorted((tuple(r) for r in fill_middle.digests(frame(rows)).collect()), key=key)
    assert digests == sorted(((*w[:5], sha(w[5]), sha(t)) for w, (_, t) in zip(wanted, rows)), key=key)
    texts = sorted((tuple(r) for r in fill_middle.texts(frame(rows)).collect()), key=key)
    assert texts == sorted(wanted, key=key)
    assert fill_middle.digests(frame([])).count() == 0 and fill_middle.texts(frame([])).count() == 0


def test_pieces_are_bounded_and_whole():
    rng = random.Random(9)
    for text in ("a " * 30_000, "x" * 200_000, " ".join("y" * rng.randint(1, 9) for _ in range(20_000)), "", "z"):
        ends = fill_middle.unit_ends(text)
        for low, high in ((0, len(ends)), (len(ends) // 3, len(ends) // 2), (0, 0), (len(ends), len(ends))):
            pieces = list(fill_middle._chunks(text, ends, low, high, "<P>"))
            cut = text[ends[low - 1] if low else 0 : ends[high - 1] if high else 0]
            assert "".join(pieces) == "<P>" + cut and max(map(len, pieces)) <= fill_middle.PIECE_CHARS + 3


def test_markers_across_pieces():
    back = fill_middle._Restorer("spm")
    parts = {0: "", 1: "", 2: ""}
    for c in "<S>su<f>x<P>p<M>mid<":
        for rank, piece in back.feed(c):
            parts[rank] += piece
    for rank, piece in back.close():
        parts[rank] += piece
    assert parts == {0: "p", 1: "mid<", 2: "su<f>x"}


def test_one_shuffle(frame):
    plan = fill_middle.digests(frame([(1, "a")]))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


# Conversations


def plain_repair(rows):
    """Brute force over whole strings: the least (cost, audit) and the result, of (role, text) rows after damage."""
    space = re.compile(r"[^\x20\x09-\x0D]")
    seen, faults = set(), []
    for role, text in rows:
        solid = space.findall(text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    best = {0: (0, "", ())}

    def better(d, state, way):
        if state not in d or way[:2] < d[state][:2]:
            d[state] = way

    def inserted(d):
        for _ in range(2):
            for s, (c, a, out) in list(d.items()):
                t = repair._NEXT[s]
                better(d, t, (c + 3, a + "I", (*out, (repair._ROLE[t], ""))))
        return d

    # All (state, text) pairs are kept, so that no choice is made before the end.
    alive = {(0, "", ()): 0}
    for (role, text), fault in zip(rows, faults):
        new = {}
        for (s, a, out), c in alive.items():
            for k in range(3):
                ways = [(s, "D", out, 4)]
                if fault not in ("blank", "duplicate"):
                    more = 3 if fault == "truncated" else 0
                    t = repair._NEXT[s]
                    ways.append((t, "R", (*out, (repair._ROLE[t], text)), 3 + more))
                    if role[:1] == "s" and s == 0:
                        ways.append((1, "K", (*out, (role, text)), more))
                    if role[:1] in ("u", "a") and role[:1] == repair._ROLE[t][0]:
                        ways.append((t, "K", (*out, (role, text)), more))
                for t, letter, o, price in ways:
                    way = (t, a + letter, o)
                    new[way] = min(new.get(way, 10**9), c + price)
                t = repair._NEXT[s]
                s, a, out, c = t, a + "I", (*out, (repair._ROLE[t], "")), c + 3
        least = {}
        for (s, a, o), c in new.items():  # of one state, only the least costs and their texts can win
            if s not in least or c < least[s]:
                least[s] = c
        alive = {w: c for w, c in new.items() if c == least[w[0]]}
    ends = []
    for (s, a, out), c in alive.items():
        if s == 0 and not out:
            ends.append((c, a, out))
        while s != 3 and (s or out):
            s = repair._NEXT[s]
            a, out, c = a + "I", (*out, (repair._ROLE[s], "")), c + 3
        if s == 3:
            ends.append((c, a, out))
    cost, audit, out = min(ends)
    return [faults.count(f) for f in ("blank", "duplicate", "truncated")], cost, audit, out


def plain_report(conv, rows):
    """rows: (turn, role, text) after damage, in order."""
    faults, cost, audit, out = plain_repair([r[1:] for r in rows])
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (conv, gaps, *faults, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out)))


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        role = "user" if h == 4 else role
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(h, 1))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], sha(f"{len(r[1])}:{r[1]}:{r[2]}"))
    return {c: sorted(v, key=order) for c, v in out.items()}


SCHEMA = "conv_id long, turn long, role string, text string, fault string, n int"


def some_rows(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "a"]
    texts = ["Yes.", "No!", "cut", "", " \n", None, "Why?  ", "Well. ok", "é漢", "x." * 50]
    rows = []
    for conv in range(n):
        size = rng.choice([1, 2, 3, 5, 8, 12])
        turns = [rng.choice([None, rng.randint(0, size)]) if rng.random() < 0.2 else i for i in range(size)]
        for t in turns:
            rows.append((conv, t, rng.choice(roles[: rng.choice([2, 9])]), rng.choice(texts)))
    rows += [(None, 0, "user", "hi."), (None, 1, None, None), (None, 1, None, None)]
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)


def key(r):
    return tuple(map(str, r))


def test_repair_equals_brute_force(spark):
    rows = some_rows(3, 150)
    got = repair.report(repair.damage(frame_of(spark, rows))).collect()
    wanted = [plain_report(c, v) for c, v in plain_damage(rows).items()]
    assert sorted((tuple(r) for r in got), key=key) == sorted(wanted, key=key)
    assert repair.report(frame_of(spark, rows).limit(0)).count() == 0


def test_blocks_make_no_difference(spark, monkeypatch):
    rows = some_rows(4, 60) + [(77, i, random.Random(i).choice(["user", "assistant", "system"]), f"text {i % 40}.") for i in range(500)]
    whole = sorted((tuple(r) for r in repair.report(frame_of(spark, rows)).collect()), key=key)
    monkeypatch.setattr(repair, "BLOCK_ROWS", 3)
    assert sorted((tuple(r) for r in repair.report(frame_of(spark, rows)).collect()), key=key) == whole


def test_crossings_choose_the_least_text():
    rng = random.Random(6)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", "c!", "d."])) for _ in range(rng.randint(0, 7))]
        seen, steps = set(), []
        for role, text in rows:
            steps.append(repair.row_step(role[0], not text or (role, text) in seen, text == "b"))
            seen.add((role, text))
        path = hirschberg.moves([*steps, repair.END], 0, 3)
        cost, audit = plain_repair(rows)[1:3]
        assert (sum(m[2] for m in path), "".join(m[3] for m in path)) == (cost, audit)


def test_repaired_messages(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (1, 4, "user", "And?"), (2, 0, "user", "Hi.")]
    out = repair.repaired(frame_of(spark, rows)).orderBy("conv_id", "part", "block", "at").collect()
    assert [(r.conv_id, r.turn, r.edit, r.role, r.text) for r in out] == [
        (1, 0, "K", "user", "Hi."), (1, 2, "K", "assistant", "Yes."), (1, 4, "K", "user", "And?"), (1, None, "I", "assistant", ""),
        (2, 0, "K", "user", "Hi."), (2, None, "I", "assistant", ""),
    ]
