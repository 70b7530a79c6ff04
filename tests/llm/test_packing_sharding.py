import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyward.llm import packing, resharding


def test_ids_are_those_of_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    reference.encode_special_tokens = True
    texts = ["Hello world", "  two  spaces\n\n\tx ", "é 漢字 🙂🙂 ñandú", "a<|endoftext|>b", "1234567 don't WE'LL", "  x", ""]
    assert [packing.encoder(path).encode_ordinary(t) for t in texts] == [
        e.ids for e in reference.encode_batch(texts, add_special_tokens=False)
    ]


def test_round_trip(odd):
    rows, docs = odd
    got = packing.pack(docs, length=64).collect()
    assert packing.pack(docs.limit(0)).count() == 0
    bpe = packing.encoder(packing.vocabulary_path())
    want = Counter((i, zlib.crc32(np.array([*bpe.encode_ordinary(t or ""), 0], "<u4").tobytes())) for i, t in rows)
    # One long stream, without gaps, in which each piece lies in one sequence.
    stream = sorted(got, key=lambda r: r.sequence_id * 64 + r.offset)
    at, held = 0, None
    found = Counter()
    for r in stream:
        assert r.sequence_id * 64 + r.offset == at and r.offset + r.length <= 64 and len(r.ids) == 4 * r.length
        at += r.length
        held = r.ids if r.start == 0 else held + r.ids
        if r.start + r.length == r.doc_tokens:
            found[r.doc_id, zlib.crc32(held)] += 1
    assert found == want


def test_flow_is_cheapest():
    supply, capacity = [5, 1, 3], [3, 3, 3]
    cost = [[0 if i == j else 1 for j in range(3)] for i in range(3)]
    flow = resharding.min_cost_flow(supply, capacity, cost)
    assert [sum(q for (i, _), q in flow.items() if i == k) for k in range(3)] == supply
    assert [sum(q for (_, j), q in flow.items() if j == k) for k in range(3)] == capacity
    assert sum(cost[i][j] * q for (i, j), q in flow.items()) == 2  # two units too many at the first


def test_shards(odd, frame):
    rows, docs = odd
    got = resharding.reshard(docs, new_shards=4).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert resharding.reshard(docs.limit(0)).count() == 0
    even = resharding.reshard(frame([(i, "x" * (i % 50)) for i in range(4000)])).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in even]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 60


def test_shards_that_fit_stay(frame):
    from pyspark.sql import functions as F

    docs = frame([(i, "abc") for i in range(1600)])
    plan = resharding.reshard(docs, F.pmod("doc_id", F.lit(16)))
    assert plan.where("shard <> old_shard").count() == 0


def test_rewrite(spark, frame, tmp_path):
    from pyspark.sql import functions as F

    docs = frame([(i, "abc") for i in range(400)])
    plan = resharding.reshard(docs, F.pmod("doc_id", F.lit(3)), new_shards=4).cache()
    written = {r.shard for r in resharding.rewrite(docs, plan, str(tmp_path / "out")).collect()}
    out = spark.read.parquet(str(tmp_path / "out"))
    assert written == {0, 1, 2, 3} and out.count() == 400
    assert {(r.doc_id, r[resharding.COPY]) for r in out.collect()} == {(r.doc_id, r.shard) for r in plan.collect()}


def test_special_tokens_are_those_of_tokenizers(frame):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|>x", "<|endoftext", "plain"]
    want = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 50256, 65]
    got = {r.doc_id: r for r in packing.pack(frame(enumerate(texts))).collect()}
    assert [np.frombuffer(got[i].ids, "<u4").tolist() for i in range(len(texts))] == [[*ids, packing.SEPARATOR] for ids in want]
