"""Services over HTTP with a transport of our own; tokenizers; late chunking; small predicates."""

import json
import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.functions.tokens import Tokenizer, Tokens, Vocabulary
from marlstone.operators import chunking as K
from marlstone.operators import embedding as E
from marlstone.operators import maintenance as M
from marlstone.operators import remote as R


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def test_limiter_keeps_both_rates():
    c = Clock()
    lim = R.Limiter(60, 6_000, c, c.sleep)  # one request and 100 tokens a second
    for _ in range(10):  # ten seconds' worth goes at once
        assert lim.wait(50) == 0
    assert lim.wait(50) == pytest.approx(1.0)
    assert lim.wait(900) > 0 and c.now < 12
    # more than a full bucket waits for a full one, and its debt is paid later
    start = c.now
    lim.wait(5_000)
    lim.wait(1)
    assert c.now - start > 30
    for _ in range(100):
        lim.wait(50)
    assert 100 / 60 * 60 <= c.now


def answers(*steps):
    """A transport that gives the steps in turn and keeps the requests."""
    seen, left = [], list(steps)

    def send(url, headers, body, seconds):
        seen.append((url, headers, json.loads(body)))
        return left.pop(0) if len(left) > 1 else left[0]
    return send, seen


def vectors(n, width=2):
    return json.dumps({"data": [{"index": i, "embedding": [float(i)] * width} for i in reversed(range(n))]}).encode()


def test_requests_retries_and_order():
    c = Clock()
    send, seen = answers((429, {"Retry-After": "7"}, b""), (None, {}, b"refused"), (200, {}, vectors(2)))
    p = R.CompatibleProvider("http://x/v1/", "m", 2, "secret", transport=send, sleep=c.sleep)
    assert p.embed(["a", "b"]).tolist() == [[0, 0], [1, 1]] and c.now == 9
    assert seen[0] == ("http://x/v1/embeddings", {"Content-Type": "application/json", "Authorization": "Bearer secret"}, {"model": "m", "input": ["a", "b"]})
    typed = R.TypedProvider("http://x", "m", 2, transport=send, kind="query")
    typed.embed(["a", "b"])
    assert seen[-1][2] == {"model": "m", "input": ["a", "b"], "input_type": "query", "truncation": True} and (typed.most_items, typed.most_tokens) == (100, 96_000)


@pytest.mark.parametrize("step, text", [((400, {}, b"bad"), "400"), ((500, {}, b"down"), "500"), ((200, {}, vectors(1)), "without all"), ((200, {}, json.dumps({"data": [{"index": 5, "embedding": [1, 1]}]}).encode()), "wrong index"),
                                        ((200, {}, vectors(2, 3)), "width 3")])
def test_failures(step, text):
    send, seen = answers(step)
    p = R.CompatibleProvider("http://x", "m", 2, transport=send, sleep=lambda s: None, attempts=3)
    with pytest.raises(R.ServiceError, match=text):
        p.embed(["a", "b"])
    assert len(seen) == (3 if step[0] == 500 else 1)


def _service(url, headers, body, seconds):
    b = json.loads(body)
    if url.endswith("rerank"):
        return 200, {}, json.dumps({"data": [{"index": i, "relevance_score": len(t) / 10} for i, t in enumerate(b["documents"])]}).encode()
    if any("poison" in t for t in b["input"]):
        return 400, {}, b"no"
    return 200, {}, json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 0.0]} for i, t in enumerate(b["input"])]}).encode()


def test_operators_over_a_service(spark):
    d = spark.createDataFrame([("a", "xx"), ("b", None), ("c", "poison"), ("d", "xxxx")], "id string, content string").coalesce(1)
    make = E.provider("compatible", url="http://x", model="m", width=2, transport=_service, most_items=1)
    got = {r["id"]: (r["embedding"], r["embed_error"]) for r in E.embed(d, make).collect()}
    assert got["a"] == ([2.0, 0.0], None) and got["b"] == (None, None) and got["d"][0] == [4.0, 0.0] and got["c"][0] is None and "400" in got["c"][1]
    rank = {r["id"]: r["relevance"] for r in R.reranked(d, "q", lambda: R.Client("http://x", transport=_service), "m").collect()}
    assert rank == {"a": 0.2, "b": None, "c": 0.6, "d": 0.4}
    assert R.reranked(d.limit(0), "q", lambda: R.Client("http://x", transport=_service), "m").collect() == []
    with pytest.raises(ValueError):
        R.reranked(d, "q", lambda: None, "m", most=2)


def test_late_chunking(spark):
    d = spark.createDataFrame([("f", 1, "red fox"), ("f", 0, "the fox"), ("f", 2, None), ("g", 0, "")], "file string, ordinal int, content string")
    got = {(r["file"], r["ordinal"]): r["embedding"] for r in E.embed_late(d, E.provider("tokens", width=8), ["file"], ["ordinal"]).collect()}
    p = E.TokenProvider(8)
    assert np.allclose(got["f", 1], p.embed(["red fox"])[0], atol=1e-6) and np.allclose(got["f", 0], p.embed(["the fox"])[0], atol=1e-6)
    assert got["f", 2] is None and not np.any(got["g", 0])


VOCABULARIES = [f"/opt/tokenizers/{n}" for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.mark.parametrize("path", VOCABULARIES)
def test_tokenizers(spark, path):
    if not os.path.exists(path):
        pytest.skip("no vocabularies here")
    tok = Tokenizer(Vocabulary.read(path))
    text = "def read(path):\n    return open(path)  # größer 漢字\n" * 40
    assert tok.count(text) == len(tok.encode(text)) == len(tok.starts(text)) and tok.encode("") == []
    m = Tokens(text, tok)
    assert m.size(0, len(text)) == tok.count(text)
    for most in (1, 7, 64):
        for pieces in (K.fitted(text, K.split_text(text, most, m), most, tok), [(c["start"], c["end"]) for c in K.split_file(text, "a.py", most, tok)]):
            assert "".join(text[a:b] for a, b in pieces) == text
            assert all(tok.count(text[a:b]) <= most or b - a == 1 for a, b in pieces)
    rows = K.chunk_files(spark.createDataFrame([("1", "p", "a.py", text), ("2", "p", "b.py", None)], "id string, project_id string, file_path string, content string"), 64, vocabulary=path).collect()
    assert "".join(r["content"] for r in rows) == text and all(r["token_ids"] == tok.encode(r["content"]) for r in rows)


def test_unknown_vocabulary():
    with pytest.raises(ValueError):
        Vocabulary.read("/tmp/x.bin")


def test_due_rescans(spark):
    now = datetime(2025, 1, 2)
    hour, minute = 3_600_000_000, 60_000_000
    rows = [("never", "Active", hour, None), ("old", "Active", hour, now - timedelta(days=1)), ("recent", "Active", hour, now - timedelta(seconds=3599)), ("just", "Active", hour, now - timedelta(hours=1)),
            ("disabled", "Active", None, None), ("pending", "PendingDeletion", minute, None), ("deleted", "Deleted", minute, now - timedelta(days=9)), ("nostatus", None, minute, None)]
    d = spark.createDataFrame(rows, "id string, status string, rescan_interval long, last_indexed_at timestamp_ntz")
    assert {r["id"] for r in M.due_rescans(d, F.lit("2025-01-02 00:00:00").cast("timestamp_ntz")).collect()} == {"never", "old", "just"}


def test_small_predicates(spark):
    d = spark.createDataFrame([("pending", "it's"), ("PENDING", None), (None, "")], "s string, t string")
    assert [r[0] for r in d.select(C.known_state("s")).collect()] == [True, False, False]
    assert [r[0] for r in d.select(C.quoted("t")).collect()] == ["'it''s'", None, "''"]
    ids = spark.createDataFrame([(C.NIL,), ("x",), (None,)], "id string")
    assert [r[0] for r in ids.filter(C.no_sentinel("id")).collect()] == ["x", None]
    tasks = spark.createDataFrame([('{"PartialUpdate": {"changes": [{"path": "a", "operation": "Add"}]}}',)], "task_type string").select(M.task_changes().alias("c"))
    assert tasks.select(M.encoded_changes("c")).first()[0] == '{"PartialUpdate":{"changes":[{"path":"a","operation":"Add"}]}}'


def test_quantiles_of_many_rows_are_exact(spark):
    from marlstone.operators import performance as P

    d = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), ((F.xxhash64("id") % 100_000) / 7.0).alias("v"))
    got = {r["g"]: r for r in P.quantile_by(d, ["g"], "v", {"low": 0.0, "mid": 0.5, "p99": 0.99, "top": 1.0}).collect()}
    for g in ("a", "b"):
        vs = sorted(r[0] for r in d.filter(F.col("g") == g).select("v").collect())
        assert [got[g][k] for k in ("low", "mid", "p99", "top")] == [vs[int((len(vs) - 1) * q + 0.5)] for q in (0.0, 0.5, 0.99, 1.0)]
    small = spark.createDataFrame([(float(i * i % 37),) for i in range(23)], "v double")
    for q in (0.0, 0.05, 0.1, 0.5, 0.9, 0.95, 1.0):
        assert P.quantile_by(small, [], "v", {"cut": q}).first()["cut"] == sorted(r[0] for r in small.collect())[int(22 * q + 0.5)]
    one = P.quantile_by(d, [], "v", {"cut": 0.95}).collect()
    vs = sorted(r[0] for r in d.select("v").collect())
    assert one[0]["cut"] == vs[int((len(vs) - 1) * 0.95 + 0.5)]
    assert P.quantile_by(d.limit(0), ["g"], "v", {"mid": 0.5}).collect() == []


def test_scratch_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from marlstone import session

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://x:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(far)
