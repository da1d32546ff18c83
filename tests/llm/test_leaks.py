import random
import re
import unicodedata

import numpy as np

from marlstone.llm import leaks as L


def words(t):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()))


def brute(docs, items):
    out = set()
    for d, t, *_ in docs:
        w = words(t)
        s = "".join(w)
        for i, lang, x, *_ in items:
            u = words(x)
            if lang in ("zh", "ja"):
                v = "".join(u)
                hit = any(v[k:k + 30] in s for k in range(len(v) - 29))
            else:
                grams = {tuple(u[k:k + 13]) for k in range(len(u) - 12)}
                hit = any(tuple(w[k:k + 13]) in grams for k in range(len(w) - 12))
            if hit and d is not None and i is not None:
                out.add((d, i))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, fp string, id int")
    i = spark.createDataFrame(items, "item_id long, lang string, text string, id int")
    return {tuple(r) for r in L.leaked_items(d, i).collect()}


def test_every_length_and_place(spark):
    rng = random.Random(1)
    vocab = [f"wort{i}é" for i in range(500)]
    items = [(k, "en", " ".join(rng.choices(vocab, k=40)), 0) for k in range(12)]
    docs = []
    for n in range(160):
        k, size = rng.randrange(12), rng.randint(8, 20)
        u = items[k][2].split()
        a = rng.randint(0, 40 - size)
        part = [x.upper() if rng.random() < 0.3 else unicodedata.normalize("NFD", x) for x in u[a:a + size]]
        text = " ".join(rng.choices(vocab, k=rng.randint(0, 30))) + rng.choice([" ", "\n// ", "\n> "]) + rng.choice([", ", " ", "\n# ", " *"]).join(part) + " " + " ".join(rng.choices(vocab, k=rng.randint(0, 9)))
        docs.append((n, text, "x", 1))
    want = brute(docs, items)
    assert 60 < len(want) < 160 and run(spark, docs, items) == want


def test_east_asian(spark):
    rng = random.Random(2)
    item = "".join(chr(rng.randint(0x4E00, 0x5E00)) for _ in range(70))
    docs = [(n, "前" * n + "、".join([item[a:a + 12], item[a + 12:a + size]]) + "。\n后", "", 0) for n, (a, size) in enumerate([(0, 30), (0, 29), (40, 30), (41, 29), (5, 60)])]
    items = [(1, "zh", item[:35] + "。" + item[35:], 0), (2, "ja", "ABC" + item[:20], 0), (3, "zh", "x" * 40, 0)]
    docs.append((9, "x" * 35, "", 0))
    assert run(spark, docs, items) == brute(docs, items) == {(0, 1), (2, 1), (4, 1), (9, 3)}


def test_odd_rows(spark):
    p = " ".join(f"p{i}" for i in range(30))
    docs = [(1, None, "", 0), (None, p, "", 0), (2, "", "", 0), (3, " \n", "", 0), (4, p, "", 0), (4, p, "", 0), (5, p, "", 0), (6, "z " * 200_000 + p, "", 0)]
    items = [(1, None, p, 0), (1, None, p, 0), (2, "en", None, 0), (None, "en", p, 0), (3, "en", "", 0), (4, "zh", "", 0)]
    assert run(spark, docs, items) == {(4, 1), (5, 1), (6, 1)}
    assert run(spark, [], items) == set() and run(spark, docs, []) == set()


def test_hot_passage(spark):
    p = " ".join(f"p{i}" for i in range(20))
    docs = [(n, f"own{n} text{n} {p}" if n % 3 == 0 else f"nothing {n}", "", 0) for n in range(300)]
    assert len(run(spark, docs, [(1, "en", p, 0), (2, "en", "x " + p, 0)])) == 200


def test_grams_depend_on_their_own_units_only():
    rng = np.random.default_rng(0)
    u = rng.integers(0, 2**63, 200).astype(np.uint64)
    for k in (1, 7, 8, 13, 20):
        h = L.grams(u, k)
        assert len(h) == 200 - k + 1
        assert all(h[i] == L.grams(u[i:i + k], k)[0] for i in range(0, len(h), 17))
    h = rng.integers(0, 100, 300).astype(np.uint64)
    assert set(L.winnowed(h, 6)) == {i for j in range(295) for i in range(j, j + 6) if h[i] == min(h[j:j + 6])}


def test_long_tags_half_width_kana_and_rare_characters(spark):
    p = " ".join(f"p{i}" for i in range(14))
    words = p.split()
    tag = f"<a title=\"{'x y ' * 120}\">"
    kana = "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマ"
    half = "ｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏ"
    rare = "".join(chr(0x20000 + 7 * i) for i in range(31))
    docs = [(1, " ".join(words[:7]) + tag + " ".join(words[7:]), "", 0), (2, half, "", 0), (3, f"one {rare} two", "", 0)]
    assert run(spark, docs, [(1, "en", p, 0), (2, "ja", kana, 0), (3, "zh", rare, 0)]) == {(1, 1), (2, 2), (3, 3)}


def test_without_a_bitmap(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_MARKS", 0)
    p = " ".join(f"p{i}" for i in range(20))
    assert run(spark, [(1, p, "", 0), (2, "x", "", 0)], [(1, "en", p, 0)]) == {(1, 1)}
