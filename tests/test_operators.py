"""Operators on small fixtures with known results."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.functions import helpers as H
from marlstone.operators import assembly as A
from marlstone.operators import chunking as K
from marlstone.operators import embedding as E
from marlstone.operators import maintenance as M
from marlstone.operators import performance as P
from marlstone.operators import search as S

CHUNKS = [
    ("1.1", "src/auth.rs", "fn login(username, password) { session }", 0.1, "function", "login", "rust", None, ["auth"], ["User"], ["username", "password"]),
    ("1.2", "src/auth.rs", "fn logout(user) { auth }", 0.2, "function", "logout", "rust", None, ["auth"], [], ["User"]),
    ("1.3", "src/auth.rs", "impl AuthMiddleware { fn check_auth }", 0.3, "impl", "AuthMiddleware", "rust", None, ["auth", "AuthMiddleware"], ["check_auth"], ["Request"]),
    ("2.1", "src/database.rs", "struct Connection { pool }", 0.4, "struct", "Connection", "rust", None, ["database"], ["Connection"], ["Pool", "Postgres"]),
    ("2.2", "src/database.rs", "impl Connection { fn execute_query }", 0.5, "method", "execute_query", "rust", "impl Connection", ["database", "Connection", "execute_query"], ["execute_query"], ["Result", "logger"]),
    ("3.1", "tests/test_auth.py", "def test_login(): assert login", 0.6, "function", "test_login", "python", None, ["test_login"], ["test_login"], ["login"]),
]
DDL = "id string, file_path string, content string, embedding array<float>, node_type string, node_name string, language string, parent_context string, scope_path array<string>, definitions array<string>, symbol_refs array<string>, project_id string"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(*r[:3], [r[3]] * 8, *r[4:], "p") for r in CHUNKS], DDL)


@pytest.mark.parametrize(("options", "want"), [
    ({}, "1.1 1.2 1.3 2.1 2.2 3.1"), ({"node_types": ["function"]}, "1.1 1.2 3.1"), ({"node_name": "login"}, "1.1"), ({"parent_context": "impl Connection"}, "2.2"), ({"scope_depth": (2, 5)}, "1.3 2.2"),
    ({"has_definitions": ["Connection"]}, "2.1"), ({"has_references": ["logger"]}, "2.2"), ({"languages": ["Python"]}, "3.1"),
    ({"node_types": ["function", "method"], "languages": ["rust"], "has_references": ["User"]}, "1.2"), ({"languages": [], "node_types": []}, "1.1 1.2 1.3 2.1 2.2 3.1"),
    ({"path": "src"}, "1.1 1.2 1.3 2.1 2.2"), ({"path": "src/auth"}, ""), ({"node_name": "^log", "patterns": True}, "1.1 1.2"), ({"node_name": "it's"}, "")])
def test_filters(chunks, options, want):
    assert sorted(r[0] for r in chunks.filter(S.metadata_filter(S.SearchOptions(**options))).select("id").collect()) == want.split()


def test_search(spark, chunks):
    q = [0.1] * 8
    near = S.top(S.vector_distances(chunks, q), F.asc("distance"), 10)
    assert [r["id"] for r in near.orderBy("rank").collect()] == ["1.1", "1.2", "1.3", "2.1", "2.2", "3.1"]
    found = S.hybrid_search(chunks, "login", q, S.SearchOptions(limit=1)).collect()
    assert len(found) == 1 and found[0]["id"] == "1.1"
    assert S.hybrid_search(chunks, "nothingofthat", q).count() == 5
    assert S.hybrid_search(chunks.limit(0), "login", q).count() == 0
    assert S.hybrid_search(chunks, "", q).count() == 5
    assert {r["id"] for r in S.bm25(chunks.union(chunks), "login").collect()} == {r["id"] for r in S.bm25(chunks, "login").collect()}
    grouped = S.grouped_search(chunks, "login", q, S.SearchOptions(limit=1, chunks_per_file=1)).collect()
    assert len(grouped) == 1 and grouped[0]["file_path"] == "src/auth.rs"
    page = S.relevance_percent(S.hybrid_search(chunks, "login", q)).join(chunks, "id").withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(2))
    assert "src/auth.rs:1-2 (100.0 %)" in S.report(page)


def test_covering_folder(spark):
    p = spark.createDataFrame([("/w/ab/y",), ("/w/a/x",), ("/q",), ("/w/a",)], "path string")
    f = spark.createDataFrame([("1", "/w"), ("2", "/w/a/"), ("3", "/w/a/x/z")], "id string, directory string")
    assert {r["path"]: r["id"] for r in M.covering_folder(p, f).collect()} == {"/w/ab/y": "1", "/w/a/x": "2", "/w/a": "2"}


def test_expand_deletes(spark):
    stored = spark.createDataFrame([("p", "src/a.py"), ("p", "src/b/c.py"), ("p", "srcx/d.py"), ("q", "src/a.py")], "project_id string, file_path string")
    gone = spark.createDataFrame([("p", "src/"), ("p", "lost.py")], "project_id string, path string")
    assert sorted(r[1] for r in M.expand_deletes(gone, stored).collect()) == ["lost.py", "src/a.py", "src/b/c.py"]


def test_replace_and_delete(spark):
    cols = "id string, project_id string, file_path string, content string"
    old = spark.createDataFrame([("1", "p", "wi.rs", "one"), ("2", "p", "wi.rs", "two"), ("3", "p", "wi.rs", "three"), ("4", "p", "x.rs", "x")], cols)
    new = spark.createDataFrame([("5", "p", "wi.rs", "one"), ("6", "p", "wi.rs", "two")], cols)
    assert sorted(r[0] for r in M.replace_files(old, new, new).collect()) == ["4", "5", "6"]
    assert sorted(r[0] for r in M.replace_files(old, new.limit(0), new).collect()) == ["4"]
    assert sorted(r[0] for r in M.stale(old, new).collect()) == ["1", "2", "3"]
    assert [t.count() for t in M.cascade_delete(new, old, old)] == [1, 1]
    up = M.upsert(old, spark.createDataFrame([("1", "p", "wi.rs", "updated")], cols), ["id"])
    assert up.filter("id = '1'").collect()[0]["content"] == "updated" and up.count() == 4
    assert M.set_where(old, F.col("content") == "x", content=F.lit("y")).filter("content = 'y'").count() == 1
    assert M.delete_where(old, F.lit(None).cast("boolean")).count() == 4


def test_merge_changes(spark):
    t = json.dumps({"PartialUpdate": {"changes": [{"path": "b", "operation": "Add"}, {"path": "a", "operation": "Delete"}]}})
    u = json.dumps({"PartialUpdate": {"changes": [{"path": "a", "operation": "Delete"}]}})
    rows = spark.createDataFrame([("p", t), ("p", u), ("p", '"FullIndex"'), ("q", None)], "project_id string, task_type string")
    out = M.merge_changes(rows, ["project_id"]).collect()
    assert [(r["project_id"], [tuple(c) for c in r["changes"]]) for r in out] == [("p", [("a", "Delete"), ("b", "Add")])]
    assert rows.filter(M.is_full()).count() == 1


def test_completeness_and_documents(spark):
    c = spark.createDataFrame([("p", "f1", "fn main() {}", "rust"), ("p", "f1", "println;", "rust"), ("p", "f2", "x", "go")], "project_id string, file_path string, content string, language string")
    e = spark.createDataFrame([("p", "f1", "fn main() {}println;", 2), ("p", "f2", "x", 2), ("p", "f3", "", 0)], "project_id string, file_path string, content string, expected_chunks int")
    got = {r["file_path"]: (r["received"], r["complete"]) for r in A.completeness(c, e, M.KEY).collect()}
    assert got == {"f1": (2, True), "f2": (1, False), "f3": (0, True)}
    docs = {r["file_path"]: r for r in A.build_documents(c, e).collect()}
    assert set(docs) == {"f1", "f3"} and docs["f1"]["primary_language"] == "rust" and docs["f3"]["languages"] == []
    assert A.build_documents(c, e).filter("file_path = 'f1'").collect()[0]["id"] == docs["f1"]["id"]


def test_token_batches(spark):
    rows = spark.createDataFrame([("g", i, t) for i, t in enumerate([5, 5, 5, 100, 1, 1, 1, 1])], "g string, i int, t int")
    out = [r["batch_id"] for r in A.token_batches(rows, ["g"], ["i"], "t", 3, 10).orderBy("i").collect()]
    assert out == [0, 0, 1, 2, 3, 3, 3, 4]


def test_ranked_hot_group(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"), "id")
    r = A.ranked(rows, ["g"], ["id"])
    assert r.filter("g = 'hot'").agg(F.max("rank"), F.countDistinct("rank")).collect()[0][:] == (1000, 1000)
    assert r.filter("g = 'hot'").orderBy("id").limit(3).select("rank").collect() == [(1,), (2,), (3,)]


def test_lines(spark):
    cases = [("abc", 3, 1, 2), ("abc", 0, 1, 1), ("a\nb\nc", 2, 2, 2), ("a\nb\nc", 3, 2, 3), ("é\n\nx", 4, 3, 3), ("", 0, 1, 1), ("\n\n", 2, 3, 3)]
    d = spark.createDataFrame(cases, "t string, o int, a int, b int")
    for r in d.select("t", "o", "a", "b", C.line_true("t", "o").alias("x"), C.line_compat("t", "o").alias("y")).collect():
        starts = [0] + [i + 1 for i, ch in enumerate(r["t"].encode()) if ch == 10]
        assert r["x"] == r["a"] and r["y"] == sum(s < r["o"] for s in starts) + 1


def test_size_buckets_and_retry(spark):
    d = spark.createDataFrame([(0,), (1023,), (1024,), (5 * 1024 * 1024,), (None,)], "s long").select(C.size_bucket("s"))
    assert [r[0] for r in d.collect()] == ["0-1KB", "0-1KB", "1-10KB", "4MB+", None]
    r = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 5, 10)], "n int").select(C.retry_delay("n"))
    assert [x[0] for x in r.collect()] == [1, 5, 10, 20, 40, 60, 60]


def test_helpers():
    assert [H.chunk_limit("free", 32000), H.chunk_limit("1", 32000), H.chunk_limit("2", 32000), H.chunk_limit("3", 32000), H.chunk_limit("3", 16000)] == [2048, 4096, 8000, 16384, 12800]
    assert H.chunk_limit("3", 32000, 1000) == 1000 and H.chunk_limit(None, 1, 700) == 700
    assert H.parse_duration("1h 30m") == 5400 and H.format_duration(5400) == "1h 30m" and H.format_duration(0) == "0s"
    assert H.parse_size("5M") == 5 * 1024**2 and H.parse_range("2,5") == (2, 5)
    assert H.canonical_path("/no/such/place/") == "/no/such/place"
    for bad in (lambda: H.canonical_path("rel"), lambda: H.parse_duration("soon"), lambda: H.parse_size("big"), lambda: H.parse_range("5,2")):
        with pytest.raises(ValueError):
            bad()
    assert H.backoff_seconds(10) == 60 and H.retryable(503) and not H.retryable(404)


@pytest.mark.parametrize("text", ["", "a", "word " * 700, "x" * 5000, "one. two! three?\n\nfour\n" * 120, "日本語の文。" * 400, "\n" * 3000])
@pytest.mark.parametrize("most", [1, 7, 50, 1500])
def test_split_text_keeps_everything(text, most):
    parts = K.split_text(text, most)
    assert "".join(text[a:b] for a, b in parts) == text
    assert all(0 < b - a <= most for a, b in parts)


CODE = {
    "a.py": "import os\n\n\ndef hello(x):\n    return os.path(x)\n\n\nclass A:\n    @property\n    def m(self):\n        return hello(1)\n",
    "a.rs": "use std::io;\n\nimpl Foo {\n    pub fn bar(&self) -> u32 {\n        baz(1)\n    }\n}\n\nfn main() { println!(\"}\"); }\n",
    "a.ts": "export class A {\n  run(x: number): void {\n    go(x);\n  }\n}\nexport const f = (a: string) => {\n  return a;\n};\n",
    "a.go": "package a\n\nfunc (m *T) Get() int {\n\treturn m.x\n}\n\ntype T struct {\n\tx int\n}\n",
    "A.java": "package a;\n\nclass A {\n    int f(int x) {\n        return g(x);\n    }\n}\n",
}


@pytest.mark.parametrize("path", sorted(CODE))
@pytest.mark.parametrize("most", [40, 1500])
def test_split_code(path, most):
    text = CODE[path]
    parts = K.split_file(text, path, most)
    assert "".join(text[c["start"]:c["end"]] for c in parts) == text
    assert all(c["end"] - c["start"] <= most for c in parts)
    assert any(c["node_type"] in ("function", "method", "class", "impl", "struct") for c in parts)
    assert parts[0]["language"] == K.detect_language(path)


def test_split_code_metadata():
    py = {c["node_name"]: c for c in K.split_file(CODE["a.py"], "a.py")}
    assert py["hello"]["node_type"] == "function" and py["hello"]["symbol_refs"] == ["path"]
    assert py["A"]["definitions"] == ["A", "m"]
    rs = [c for c in K.split_file(CODE["a.rs"], "a.rs", 60) if c["node_name"] == "bar"]
    assert rs and rs[0]["parent_context"] == "Foo" and rs[0]["scope_path"] == ["Foo", "bar"]
    assert K.split_file("def f(:\n", "a.py")[0]["node_type"] == "text_chunk"
    assert K.detect_language("x", "#!/usr/bin/env python3\n") == "python" and K.detect_language("x") is None
    assert len(K.supported_languages()) >= 30 and K.is_supported("Python")


def test_chunk_files_ranges(spark):
    rows = [(str(i), "p", path, text) for i, (path, text) in enumerate(CODE.items())] + [("n", "p", "n.py", None), ("e", "p", "e.py", ""), ("u", None, None, "é\n日本\n" * 300)]
    f = spark.createDataFrame(rows, "id string, project_id string, file_path string, content string")
    texts = {r[0]: r[3] for r in rows}
    by = {}
    for c in K.chunk_files(f, 100).collect():
        by.setdefault(c["file_id"], []).append(c)
    assert set(by) == {"0", "1", "2", "3", "4", "u"}
    for i, cs in by.items():
        cs.sort(key=lambda c: c["ordinal"])
        raw = texts[i].encode()
        assert b"".join(raw[c["start_byte"]:c["end_byte"]] for c in cs) == raw
        for c in cs:
            assert c["start_line"] == raw[:c["start_byte"]].count(b"\n") + 1 and c["end_line"] >= c["start_line"]


def test_embedding(spark):
    rows = spark.createDataFrame([("p", f"f{i % 3}", f"text {i}") for i in range(9)] + [("p", "n", None)], "project_id string, file_path string, content string").coalesce(1)
    a = E.embed(rows, E.provider("hash", width=40)).collect()
    assert all(len(r["embedding"]) == 40 for r in a if r["content"]) and [r["embedding"] for r in a if r["content"] is None] == [None]

    class Breaks(E.HashProvider):
        def __init__(self):
            super().__init__(8)
            self.most_items, self.n = 2, 0

        def embed(self, texts):
            self.n += 1
            if self.n == 2:
                raise OSError("down")
            return super().embed(texts)

    out = E.embed(rows, Breaks)
    assert sum(r["embed_error"] is not None for r in out.collect()) == 2
    failed = {r["file_path"] for r in E.failed_files(out).collect()}
    assert failed == {"f2", "f0"} and A.without_failed(rows, E.failed_files(out), M.KEY).select("file_path").distinct().count() == 2
    with pytest.raises(ValueError):
        E.check_width(E.embed(rows, E.provider("hash", width=40)), 64)
    with pytest.raises(ValueError):
        E.provider("nothing")
    t = np.arange(12, dtype=np.float32).reshape(4, 3)
    assert (E.pool(t, np.array([1, 1, 0, 0]), "mean") == t[:2].mean(0)).all() and (E.pool(t, how="first") == t[0]).all() and (E.pool(t, how="last") == t[3]).all()
    late = E.late_chunks([t[:1], t[1:]])
    assert np.allclose(np.linalg.norm(late, axis=1), 1) and np.allclose(late[1], t[1:].mean(0) / np.linalg.norm(t[1:].mean(0)))


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.integers(0, 40, 301)] + [("b", 1.0), ("c", None)]
    d = spark.createDataFrame(rows, "g string, v double")
    out = {r["g"]: r for r in P.quantile_by(d, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p95": 0.95}).collect()}
    s = sorted(x for g, x in rows if g == "a")
    for name, q in (("p10", 0.1), ("p50", 0.5), ("p95", 0.95)):
        assert out["a"][name] == s[int((len(s) - 1) * q + 0.5)]
    assert out["b"]["p50"] == 1.0 and "c" not in out
    plain = d.groupBy("g").agg(C.nearest_rank("v", 0.95).alias("q")).filter("g = 'a'").collect()[0]["q"]
    assert plain == out["a"]["p95"]


def test_unit_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(C.unit_vector("v").alias("u"))
    assert [list(r[0]) for r in d.collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_dedup_hash_counts_the_texts_themselves(spark, data, monkeypatch):
    from marlstone.plans import reference

    monkeypatch.setattr(reference.C, "content_digest", lambda c: F.when(F.col(c).isNotNull(), F.lit("x")))
    r = reference.dedup_hash(spark, data).collect()[0]
    assert r["texts"] == 1 and r["same"] == spark.read.parquet(f"{data}/documents.parquet").select("text").filter("text is not null").distinct().count() > 1
