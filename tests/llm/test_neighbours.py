import numpy as np
import pytest

from marlstone.llm import neighbours as V


def exact(ids, m, k=5):
    m = m / np.linalg.norm(m, axis=1)[:, None]
    cos = np.round(m @ m.T, 9)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-cos[i, j], ids[j]))[:k]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in order}
    return out


def clustered(n, seed=0, spread=0.35):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((max(1, n // 20), 64))
    m = c[rng.integers(0, len(c), n)] + spread * rng.standard_normal((n, 64))
    return [f"v{i:05d}" for i in range(n)], m.astype(np.float32)


def frame(spark, ids, m, more=()):
    return spark.createDataFrame([(i, [float(x) for x in v], 1, "e") for i, v in zip(ids, m)] + list(more), "id string, embedding array<float>, vid int, cell string")


def test_recall(spark):
    ids, m = clustered(1500)
    got = {tuple(r) for r in V.neighbour_pairs(frame(spark, ids, m)).collect()}
    want = exact(ids, m.astype(np.float64))
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97


def test_far_vectors_are_found_by_scan(spark):
    rng = np.random.default_rng(5)
    ids, m = [f"r{i}" for i in range(200)], rng.standard_normal((200, 64)).astype(np.float32)
    assert {tuple(r) for r in V.neighbour_pairs(frame(spark, ids, m)).collect()} == exact(ids, m.astype(np.float64))


def test_copies_scale_and_odd_rows(spark):
    ids, m = clustered(120, 2)
    hot = [(f"h{i:03d}", [float(x) for x in m[0] * (1 + i)], 1, None) for i in range(60)]  # half as many rows again hold one direction
    odd = [("null", None, 1, ""), (None, [1.0] * 64, 1, ""), ("zero", [0.0] * 64, 1, ""), ("wide", [1.0] * 65, 1, ""), ("empty", [], 1, ""), ("nan", [float("nan")] * 64, 1, ""), ("hole", [None] * 64, 1, "")]
    near = V.similar_vectors(frame(spark, ids, m, [*hot, *hot[:3], *odd])).collect()
    by = {}
    for r in near:
        by.setdefault(r["id"], []).append((r["place"], r["other"]))
    assert set(by) == {*ids, *(h[0] for h in hot)} and all(len(v) == 5 for v in by.values())
    assert [o for _, o in sorted(by["h007"])] == ["h000", "h001", "h002", "h003", "h004"] and [o for _, o in sorted(by["h002"])] == ["h000", "h001", "h003", "h004", "h005"]


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_few(spark, n):
    ids, m = clustered(20, 3)
    got = {tuple(r) for r in V.neighbour_pairs(frame(spark, ids[:n], m[:n])).collect()}
    assert got == exact(ids[:n], m[:n].astype(np.float64)) if n else got == set()


@pytest.mark.parametrize("size, words", [(10, 1), (15, 2), (24, 3)])
def test_pair_meets_once(size, words):
    rng = np.random.default_rng(1)
    x = [rng.integers(0, 2**63, 120, dtype=np.int64).view(np.uint64) for _ in range(words)]
    for flips in range(0, 18):
        y = [c.copy() for c in x]
        for i in range(len(x[0])):
            for b in rng.choice(6 * size, flips, replace=False):
                y[b // 64][i] ^= np.uint64(1) << np.uint64(b % 64)
        times = np.zeros(len(x[0]), dtype=int)
        for i, (kx, ky) in enumerate(zip(V._keys(x, 6, size), V._keys(y, 6, size))):
            for k in set(kx.tolist()) & set(ky.tolist()):
                times[i] += bool(V._met(np.array([k]), [c[i:i + 1] for c in x], [c[i:i + 1] for c in y], size)[0])
        assert (times == 1).all(), flips


@pytest.mark.parametrize("total", [1, 1_500, 12_000, 120_000, 1_200_000, 10**8])
def test_reach_and_buckets_at_every_size(total):
    size = V.substring_length(total)
    assert 3 * V.TABLES - 1 >= 17
    # a bucket of spread codes holds about as many at every size
    assert total * (size + 1) / 2**size < 30 * 2**V.SHARED


def test_more_tables_where_the_sample_asks_for_them():
    rng = np.random.default_rng(3)
    q = rng.standard_normal((300, 64))
    turns = [V.rotation(q, 7 + i, 3)[1] for i in range(V.words_of(V.MOST, 14))]
    near = {s: q + s * rng.standard_normal(q.shape) for s in (0.1, 0.8, 1.0)}
    found = {s: V.table_count(q, n, q.mean(axis=0), turns, 14) for s, n in near.items()}
    assert found[0.1][0] == V.TABLES and found[0.1][1] >= V.TARGET
    assert found[0.8][0] > V.TABLES
    # neighbours beyond the radius are found by no number of tables
    assert found[1.0][0] == V.MOST and found[1.0][1] < V.TARGET


def test_crowded_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 32)
    rng = np.random.default_rng(9)
    ids, m = clustered(300, 4)
    dense = (m[0] + 0.02 * rng.standard_normal((300, 64))).astype(np.float32)
    ids, m = [*ids, *(f"x{i:04d}" for i in range(300))], np.concatenate([m, dense])
    report = {}
    near = V.similar_vectors(frame(spark, ids, m), hot=100, report=report).select("id", "other").collect()
    want = exact(ids, m.astype(np.float64))
    got = {tuple(sorted(r)) for r in near}
    assert report["hot"] > 0 and len(near) == 3000 and len(got & want) / len(want) >= 0.97


def test_report(spark):
    ids, m = clustered(400, 6)
    report = {}
    V.neighbour_pairs(frame(spark, ids, m), report=report).count()
    assert report["vectors"] == 400 and report["share"] >= V.TARGET and report["compared"] == 0
