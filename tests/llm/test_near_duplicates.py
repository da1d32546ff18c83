import random
import re
from itertools import combinations

import pyarrow.parquet as pq

from marlstone.llm import near_duplicates as N

DDL = "id string, content string, fp long, value string, n int"


def brute(rows, threshold=0.6, least=20):
    sets = {}
    for i, t, *_ in rows:
        if i is None or t is None:
            continue
        w = re.findall(r"\w+", t)
        if len(w) >= least:
            sets[i] = set(zip(w, w[1:], w[2:]))
    return {tuple(sorted(p)) for p in combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) >= threshold}


def made(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, head = [], " ".join(rng.choices(vocab, k=12))
    for g in range(n):
        base = rng.choices(vocab, k=rng.randint(22, 90))
        for k in range(rng.randint(1, 4)):
            t = base[:]
            for _ in range(rng.randint(0, 8)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((f"{g}-{k}", head + " " + " ".join(t), 1, "x", 2))
    return rows


def found(spark, rows):
    return {tuple(r) for r in N.near_duplicate_pairs(spark.createDataFrame(rows, DDL)).collect()}


def test_against_all_pairs(spark):
    for seed in (1, 2):
        rows = made(seed)
        assert found(spark, rows) == brute(rows)


def test_hot_copies_and_odd_rows(spark):
    rows = made(3, 20)
    copy = " ".join(f"c{i}" for i in range(40))
    rows += [(f"copy{i}", copy, 0, None, None) for i in range(40)] + [("near", copy.replace("c5 ", "zz "), 0, None, None)]
    rows += [("null", None, 0, None, 0), (None, copy, 0, None, 0), ("empty", "", 0, "", 0), ("short", "a b c", 0, "", 0), ("long", "word " * 100_000, 0, "", 0), rows[0], rows[0]]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == set()


def test_classes(spark):
    rows = made(4, 30) + [("dup", made(4, 30)[0][1], 0, "", 0)]
    pairs = brute(rows)
    root = {r[0]: r[0] for r in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    want = {i: (min(k for k in root if top(k) == top(i)), sum(i in p for p in pairs)) for i in root}
    got = {r["id"]: (r["class_id"], r["links"]) for r in N.near_duplicate_classes(spark.createDataFrame(rows, DDL)).collect()}
    assert got == want


def test_components_of_a_chain(spark):
    got = {r["node"]: r["root"] for r in N.components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_tables(spark, data):
    t = pq.read_table(f"{data}/code_chunks.parquet", columns=["id", "content"]).to_pylist()
    got = {tuple(r) for r in N.near_duplicate_pairs(spark.read.parquet(f"{data}/code_chunks.parquet")).collect()}
    assert got == brute([(r["id"], r["content"]) for r in t])


def test_exact_setting(spark):
    rows = made(11, 40)
    # few retained values and a short prefix lose pairs; at the size of the sets nothing is lost
    exact = {tuple(r) for r in N.near_duplicate_pairs(spark.createDataFrame(rows, DDL), k=1_000, prefix=1_000, slack=float("inf")).collect()}
    few = {tuple(r) for r in N.near_duplicate_pairs(spark.createDataFrame(rows, DDL), k=4, prefix=1).collect()}
    assert exact == brute(rows) and few <= exact
    classes = N.near_duplicate_classes(spark.createDataFrame(rows, DDL), k=1_000, prefix=1_000, slack=float("inf")).collect()
    assert sum(r["links"] for r in classes) == 2 * len(exact)


def shuffled(spark, after):
    """Bytes that stages above ``after`` wrote to shuffles, and the last stage."""
    gw = spark.sparkContext._gateway
    none = gw.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gw.new_array(gw.jvm.double, 0), none)
    each = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in each if s.stageId() > after), max([-1, *(s.stageId() for s in each)])


def test_common_phrases_move_no_pairs(spark):
    rng = random.Random(5)
    phrases = [" ".join(f"p{i}x{j}" for j in range(5)) for i in range(100)]
    rows = [(f"{i}", " ".join(rng.sample(phrases, 10)), 1, "x", 2) for i in range(600)]
    rows += [(f"{i}-like", rows[i][1] + " end", 1, "x", 2) for i in range(20)]
    _, last = shuffled(spark, -1)
    got = found(spark, rows)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    # about 140,000 pairs of records share a phrase's run; only records may move, not these pairs
    assert shuffled(spark, last)[0] < 15_000 * len(rows)
    assert got == brute(rows)


def test_lists_over_many_batches(spark):
    rows, old = made(6, 30), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
