import hashlib
import random

import numpy as np

from tallyward.llm import syncmers


def plain_anchors(text):
    """(position, passage) of the closed syncmers of a text, one k-mer at a time."""
    k, s = syncmers.K, syncmers.S
    one = lambda t: int(syncmers.span_hashes(syncmers._code_points(t), np.array([0]), np.array([len(t)]))[0])
    inner = [one(text[i : i + s]) for i in range(len(text) - s + 1)]
    out = [
        (i, text[i : i + k]) for i in range(len(text) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])
    ]
    return out or ([(0, text)] if text else [])


def plain_likeness(a, b):
    """Anchors matched in order, by the quadratic recurrence, as a share of all."""
    left, right = plain_anchors(a), plain_anchors(b)
    if not left and not right:
        return 1.0

    def numbered(marks):
        seen, out = {}, {}
        for place, (_, m) in enumerate(marks):
            out[m, seen.get(m, 0)] = place
            seen[m] = seen.get(m, 0) + 1
        return out

    there = numbered(right)
    pairs = sorted((p, there[m]) for m, p in numbered(left).items() if m in there)
    best = []
    for k, (_, q) in enumerate(pairs):
        best.append(1 + max((best[j] for j in range(k) if pairs[j][1] < q), default=0))
    common = max(best, default=0)
    return common / (len(left) + len(right) - common)


def words(rng, n):
    return " ".join("".join(rng.choice("aeiourstnl") for _ in range(rng.randint(2, 9))) for _ in range(n))


def like(a, b):
    return syncmers.likeness(*syncmers.fingerprint([a, b]))


def test_likeness_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        a = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 200)))
        b = rng.choice([a, a[::-1], a[40:] + a[:40], a[:90] + "zz" + a[95:], "".join(rng.choice("ab ") for _ in range(150))])
        assert like(a, b) == plain_likeness(a, b), (a, b)
    assert like("", "") == 1 and like("", "abc") == 0 == like("abc", "abd") and like("abc", "abc") == 1


def test_compare_equals_brute_force(frame):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(0, 40))) for i in range(40)] + [(7, "again and again and again"), (None, "no id"), (None, None)]
    lowest = -(1 << 63)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ordered = sorted(((lowest if i is None else i, t or "") for i, t in rows), key=lambda r: (r[0], sha(r[1])), reverse=True)
    want = []
    for k, (i, t) in enumerate(ordered):
        follower = ordered[(k + 1) % len(ordered)][1]
        changed = syncmers.edited(t, follower)
        want.append((i, sha(changed), plain_likeness(t, changed), plain_likeness(t, follower)))
    got = syncmers.compare(frame(rows)).collect()
    assert sorted((lowest if r.doc_id is None else r.doc_id, r.edited_sha256, r.near_edited, r.near_next) for r in got) == sorted(want)
    one = syncmers.compare(frame([(1, "abcdefghijklmnopqrstuvwxyz")])).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_shared_passage_of_long_texts_is_found():
    rng = random.Random(6)
    passage = words(rng, 60)
    a, b = (f"{words(rng, 4000)} {passage} {words(rng, 4000)}" for _ in range(2))
    marks = syncmers.fingerprint([a, b])
    i, j = syncmers.matches(*marks)
    inside = [p for p in marks[0][0][i] if a.index(passage) <= p < a.index(passage) + len(passage)]
    assert len(inside) > len(passage) / 8
    assert syncmers.likeness(*marks) >= len(inside) / sum(len(m[1]) for m in marks) > like(words(rng, 8000), words(rng, 8000))


def test_order_counts():
    rng = random.Random(7)
    text = words(rng, 3000)
    blocks = [text[i : i + 200] for i in range(0, len(text), 200)]
    rng.shuffle(blocks)
    assert like(text, "".join(blocks)) < 0.3 and like(text, text) == 1
    assert like(text, text[:9000] + "x" + text[9000:]) > 0.95


def test_fingerprints_are_whole(frame):
    text = words(random.Random(8), 20_000)
    got = {r.doc_id: r.fingerprint for r in syncmers.fingerprints(frame([(1, text), (2, "ab"), (3, None), (4, text)])).collect()}
    assert len(got[1]) == 16 * len(syncmers.anchors([text])[0]) and got[1] == got[4] and len(got[2]) == 16 and got[3] == b""


def test_null_and_repeated_ids(frame):
    rows = [(None, f"{i} text") for i in range(500)] + [(3, f"{i} other") for i in range(500)]
    got = syncmers.compare(frame(rows)).collect()
    assert len(got) == 1000 and len({r.edited_sha256 for r in got}) > 900
