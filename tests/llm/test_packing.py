import random

import pytest

from marlstone.llm import packing as K


@pytest.mark.parametrize("seed", range(6))
def test_slots(seed):
    rng = random.Random(seed)
    cap = rng.choice([16, 100, 512])
    hist = {n: rng.randint(1, 30) for n in rng.sample(range(1, cap + 1), min(cap, 20))}
    fill, pieces = {}, 0
    for length, lo, hi, first, each in K.slots(hist, cap):
        for r in range(lo, hi):
            c = first + (r - lo) // each
            fill[c] = fill.get(c, 0) + length
            pieces += 1
    assert pieces == sum(hist.values()) and max(fill.values()) <= cap
    assert sum(fill.values()) == sum(k * v for k, v in hist.items()) and set(fill) == set(range(len(fill)))
    for length in hist:
        ranks = sorted(r for x, lo, hi, *_ in K.slots(hist, cap) if x == length for r in range(lo, hi))
        assert ranks == list(range(hist[length]))


def pack(spark, counts, caps, **k):
    c = spark.createDataFrame(counts, "doc_id long, tokens long, length string, share int")
    return K.packed(c, spark.createDataFrame(caps, "limit_id long, label string, capacity_tokens long"), **k).collect()


def test_whole_documents(spark):
    rng = random.Random(1)
    counts = [(i, 64 if i % 3 == 0 else rng.randint(0, 900), "", 0) for i in range(600)]  # one length holds a third
    counts += [(1000, 0, "", 0), (1001, None, "", 0), (None, 5, "", 0), (5, counts[5][1], "", 0)]
    rows = pack(spark, counts, [(1, "a", 256), (2, "b", 1000), (3, "none", None), (4, "zero", 0), (2, "b", 1000)], shares=8)
    want = {i: n or 0 for i, n, *_ in counts if i is not None}
    for limit, cap in ((1, 256), (2, 1000)):
        mine = [r for r in rows if r["limit_id"] == limit]
        fill, docs = {}, {}
        for r in mine:
            fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
            docs.setdefault(r["doc_id"], []).append(r)
        assert max(fill.values()) <= cap and {d: sum(r["tokens"] for r in v) for d, v in docs.items()} == want
        for d, v in docs.items():
            v.sort(key=lambda r: r["piece"])
            assert len(v) == max(1, -(-want[d] // cap))
            assert [r["first_token"] for r in v] == [k * cap for k in range(len(v))] and all(r["tokens"] == cap for r in v[:-1])
        assert sum(fill.values()) / (cap * len(fill)) > 0.95
    assert {r["limit_id"] for r in rows} == {1, 2}


def test_empty(spark):
    assert pack(spark, [], [(1, "a", 10)]) == [] and pack(spark, [(1, 5, "", 0)], []) == []


def test_tokens(spark, data):
    import tiktoken

    docs = spark.createDataFrame([(1, "Hello world, hello!"), (2, None), (3, ""), (4, "日本 \n\n x" * 1000), (5, "<|endoftext|>")], "doc_id long, text string")
    n = {r[0]: r[1] for r in K.token_counts(docs, "doc_id", "text").collect()}
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(K.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert n == {1: 5, 2: 0, 3: 0, 4: len(enc.encode_ordinary("日本 \n\n x" * 1000)), 5: len(enc.encode_ordinary("<|endoftext|>"))}
    packed = K.pack_documents(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/pack_limits.parquet"))
    assert packed.select("limit_id", "doc_id").distinct().count() == 4 * spark.read.parquet(f"{data}/documents.parquet").count()


@pytest.mark.parametrize("hist", [{3: 40_000}, {3: 40_000, 700: 900, 5_000: 2}, {1: 100_001, 2: 7, 4_000: 30}])
def test_very_short_texts_fill_containers(hist):
    cap = 5_000
    out, fill = K.slots(hist, cap), {}
    for length, lo, hi, first, each in out:
        for r in range(lo, hi):
            c = first + (r - lo) // each
            fill[c] = fill.get(c, 0) + length
    assert sum(fill.values()) == sum(k * v for k, v in hist.items()) and max(fill.values()) <= cap
    assert len(fill) == -(-sum(fill.values()) // (cap - cap % min(hist))) and len(out) < 500


def test_more_shares_change_nothing_but_the_work(spark):
    counts = spark.createDataFrame([(i, 40 + i % 3) for i in range(300)] + [(1_000, 999)], "doc_id long, tokens long")
    limits = spark.createDataFrame([(1, 100), (2, 250)], "limit_id long, capacity_tokens long")
    boxes = []
    for shares in (None, 2, 500):
        packs = K.packed(counts, limits, shares)
        facts = {r["limit_id"]: r for r in K.packing_facts(packs, counts, limits).collect()}
        assert all(r["documents"] == 301 and r["torn"] == 0 and r["over"] == 0 for r in facts.values())
        boxes.append(sorted((r[0], r[1]) for r in packs.groupBy("limit_id").agg({"container": "max"}).collect()))
    assert boxes[0] == boxes[1] == boxes[2]
    # a container too full and a document without a piece are seen
    bad = K.packed(counts, limits).filter("doc_id <> 1000 or piece > 0")
    assert sum(r["torn"] for r in K.packing_facts(bad, counts, limits).collect()) > 0
