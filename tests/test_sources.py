"""File trees, versioned tables, logs, rendering, streams."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.operators import performance as P
from marlstone.sources import files, logs, render, schemas
from marlstone.sources.store import Table
from marlstone.streaming import jobs


@pytest.fixture
def tree(tmp_path):
    for path, raw in {"src/__init__.py": b"x = 1\n", "src/main.py": b"def main():\n    pass\n", "docs/read.md": b"# hi\n", "bin/blob": b"\0\1", "bad.txt": b"\xff\xfe\x00a", "latin.txt": "é".encode("latin-1"), "empty.py": b"",
                      ".git/config": b"x", "target/a.rs": b"x", "log/a.log": b"x", "keep/b.log": b"y", "big.txt": b"z" * 6000, "data.csv": b"a,b\n"}.items():
        p = tmp_path / "t" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(raw)
    (tmp_path / "t/.gitignore").write_text("# comment\n*.log\n!/keep/b.log\n")
    return str(tmp_path / "t")


def test_listing(spark, tree):
    names = [p for p, _, _ in files.list_files(tree, 5000)]
    assert names == ["bad.txt", "latin.txt", "bin/blob", "docs/read.md", "keep/b.log", "src/__init__.py", "src/main.py"]
    assert files.listing(spark, tree, 5000).count() == 7
    assert files.included(tree, f"{tree}/src/main.py") and not files.included(tree, f"{tree}/log/a.log") and not files.included(tree, "/etc/passwd") and not files.included(tree, f"{tree}/.git/config")


def test_scan(spark, tree):
    found, gone = files.scan_tree(spark, tree, max_size=5000)
    rows = {r["file_path"]: r for r in found.collect()}
    assert {k: v["state"] for k, v in rows.items()} == {"bad.txt": "binary", "latin.txt": "undecodable", "bin/blob": "binary", "docs/read.md": "read", "keep/b.log": "read", "src/__init__.py": "read", "src/main.py": "read"}
    assert rows["src/main.py"]["language"] == "python" and gone.count() == 0
    stored = found.filter("state = 'read'").select("file_path", "content_hash")
    stored = spark.createDataFrame(stored.collect() + [("lost.py", b"1")], "file_path string, content_hash binary")
    with open(os.path.join(tree, "src/main.py"), "a") as f:
        f.write("# more\n")
    again, gone = files.scan_tree(spark, tree, stored, 5000)
    assert sorted(r[0] for r in again.filter("state = 'read'").collect()) == ["src/main.py"]
    assert [r[0] for r in gone.collect()] == ["lost.py"]
    some, gone = files.scan_paths(spark, tree, ["src/main.py", "nowhere.py", "log/a.log"])
    assert [r[0] for r in some.collect()] == ["src/main.py"] and [r[0] for r in gone.collect()] == ["nowhere.py"]


def test_store(spark, tmp_path):
    t = Table(spark, str(tmp_path), "documents", ["project_id"])
    assert t.read().count() == 0 and t.versions() == []
    doc = lambda i, path, text, project="p": (i, project, path, text)
    ddl = "id string, project_id string, file_path string, content string"
    t.upsert(spark.createDataFrame([doc("1", "a", "x"), doc("2", "b", "y"), doc("3", "a", "z", "q")], ddl))
    t.upsert(spark.createDataFrame([doc("4", "a", "new")], ddl))
    assert sorted((r["project_id"], r["file_path"], r["content"]) for r in t.read().collect()) == [("p", "a", "new"), ("p", "b", "y"), ("q", "a", "z")]
    t.delete_files(spark.createDataFrame([("p", "b")], "project_id string, file_path string"))
    assert t.read().count() == 2 and t.read(1).count() == 3
    t.update(F.col("project_id") == "q", content=F.lit("w"))
    assert t.read().filter("content = 'w'").count() == 1
    os.makedirs(tmp_path / "documents/v=99")  # a write that died
    assert t.versions()[-1] == 4
    t.append(spark.createDataFrame([doc("5", "c", "c")], ddl))
    assert t.read().count() == 3
    t.delete(F.col("id") == "5")
    assert t.compact(keep=1, files=1) and t.read().count() == 2 and len(t.versions()) == 1
    with pytest.raises(ValueError):
        Table(spark, str(tmp_path), "nothing")
    lists = schemas.conform(spark.createDataFrame([(["a", None],), (None,)], "languages array<string>"), "documents")
    assert [r["languages"] for r in lists.collect()] == [["a"], []]


def test_chunk_store_replaces(spark, tmp_path):
    t = Table(spark, str(tmp_path), "chunks")
    ddl = "id string, project_id string, file_path string, content string"
    t.replace_files(spark.createDataFrame([("1", "p", "f", "one"), ("2", "p", "f", "two"), ("3", "p", "g", "g")], ddl))
    t.replace_files(spark.createDataFrame([("4", "p", "f", "one")], ddl))
    assert sorted(r["id"] for r in t.read().collect()) == ["3", "4"]


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([("rust", 1_700_000_000_000, 500, 1.5, "parser"), ("rust", 1_700_000_000_001, 2000, 2.5, "tokenizer"), ("c sharp", 1, 10, 3.0, "other")], "language string, timestamp_ms long, file_size long, duration_ms double, operation string")
    folder = str(tmp_path / "raw")
    logs.write_raw(rows, folder)
    back = spark.read.schema(logs.RAW).option("header", True).csv(f"{folder}/f=rust.csv")
    assert back.count() == 2
    flat = tmp_path / "flat"
    flat.mkdir()
    (flat / "rust.csv").write_text("timestamp_ms,file_size,bucket,duration_ms,operation\n1,500,0-1KB,1.5,parser\nbroken,line\n2,2000,1-10KB,2.5,tokenizer\n")
    got = logs.read_raw(spark, str(flat))
    assert sorted((r["language"], r["duration_ms"]) for r in got.collect()) == [("rust", 1.5), ("rust", 2.5)]
    logs.write_summary(rows, str(tmp_path / "sum"))
    assert {r["key"] for r in P.online_stats(rows).collect()} == {"rust_parser", "rust_tokenizer", "c sharp"}
    (flat / "log.csv").write_text("timestamp_ms,file_path,language,file_size,duration_ms,operation\n1,a,rust,5,1.0,parser\n")
    assert logs.read_log(spark, str(flat / "log.csv")).count() == 1


def test_render(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, None), ("b\tc", 22, "x")], "name string, n int, m string").orderBy("n")
    assert render.as_table(d, ["name", "n"]).split("\n")[0].split() == ["name", "n"]
    assert render.as_tsv(d, header=False) == "a\t1\t\nb c\t22\tx"
    assert json.loads(render.as_json(d, ["n"])) == [{"n": 1}, {"n": 22}]
    render.write_tsv(d, str(tmp_path / "o"))
    assert [r[0] for r in render.tsv_lines(d, ["name", "n"]).collect()] == ["a\t1", "b c\t22"]


EVENTS = [(1, "p", "a", "create", "file", "2025-01-01 00:00:00"), (2, "p", "a", "modify", "content", "2025-01-01 00:00:03"), (3, "p", "a", "remove", None, "2025-01-01 00:00:07"), (4, "p", "a", "modify", "content", "2025-01-01 00:01:00"),
          (5, "p", "b", "access", None, "2025-01-01 00:00:00"), (6, "p", "b", "create", "folder", "2025-01-01 00:00:00")]


def test_debounce(spark):
    e = spark.createDataFrame([(*x[:5], datetime.fromisoformat(x[5])) for x in EVENTS], jobs.EVENTS)
    assert [(r["operation"], r["events"]) for r in jobs.debounced(e).orderBy("since").collect()] == [("Delete", 3), ("Update", 1)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = lambda i, path, text: json.dumps({"id": i, "project_id": "p", "file_path": path, "content": text})
    (src / "1.json").write_text("\n".join([row("1", "a.py", "def f():\n    pass\n"), row("2", "b.txt", "hello")]))
    docs, chunks = Table(spark, str(tmp_path), "documents"), Table(spark, str(tmp_path), "chunks")
    stream = lambda: spark.readStream.schema("id string, project_id string, file_path string, content string").json(str(src))
    jobs.index_stream(stream(), docs, chunks, str(tmp_path / "cp")).awaitTermination()
    assert docs.read().count() == 2 and chunks.read().count() == 2
    (src / "2.json").write_text(row("1", "a.py", "x = 1\n"))
    jobs.index_stream(stream(), docs, chunks, str(tmp_path / "cp")).awaitTermination()
    assert docs.read().count() == 2 and {r["content"] for r in chunks.read().collect()} == {"x = 1\n", "hello"}
    ev = tmp_path / "ev"
    ev.mkdir()
    keys = ("event_id", "project_id", "path", "kind", "detail", "at")
    (ev / "1.json").write_text("\n".join(json.dumps(dict(zip(keys, x))) for x in [*EVENTS, (9, "p", "z", "create", "file", "2025-01-02 00:00:00")]))
    q = jobs.debounced(jobs.file_events(spark, str(ev))).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("bursts").filter("path = 'a'").count() == 2


def test_complete_files(spark):
    at = datetime(2025, 1, 1)
    parts = spark.createDataFrame([("p", "f", None, at), ("p", "f", 2, at), ("p", "f", None, at), ("p", "g", 3, at)], "project_id string, file_path string, expected_chunks int, at timestamp")
    assert {r["file_path"]: r["complete"] for r in jobs.complete_files(parts).collect()} == {"f": True, "g": False}
    assert C.SIZE_LABELS[0] == "0-1KB"
