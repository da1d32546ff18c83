"""The kept index: same scores as the scan, segments, replaced and removed rows."""

from pyspark.sql import functions as F

from marlstone.operators import search as S
from marlstone.operators.text_index import TextIndex

DDL = "id string, content string, language string, bucket int, seg int"


def rows(spark, *texts):
    return spark.createDataFrame([(i, t, "Rust", 1, 2) for i, t in texts], DDL)


def scores(df):
    return sorted((r["id"], r["score"]) for r in df.collect())


FIRST = [("a", "retry the window, retry"), ("b", "window of the log"), ("c", "nothing here"), ("d", None), ("e", ""), ("a", "retry the window, retry")]


def test_index_gives_the_scores_of_the_scan(spark, tmp_path):
    d = rows(spark, *FIRST, (None, "retry"))
    index = TextIndex(spark, str(tmp_path / "i"), 8)
    assert S.bm25(d, "retry", index=index).collect() == []
    index.add(d)
    for q in ("retry window", "Window", "log LOG", "absent", "!?", "nothing the"):
        assert scores(S.bm25(d, q, index=index)) == scores(S.bm25(d.filter("id is not null"), q)), q
    keep = F.col("id") != "a"
    assert scores(S.bm25(d, "retry window", keep, index=index)) == scores(S.bm25(d.filter("id is not null"), "retry window", keep))
    assert S.hybrid_search(d.withColumn("embedding", F.array(F.lit(1.0))), "retry", [1.0], index=index).count() == 5


def test_segments_replace_remove_and_compact(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), 8)
    index.add(rows(spark, *FIRST))
    index.add(rows(spark, ("b", "retry and retry again"), ("f", "window")))
    now = rows(spark, ("a", FIRST[0][1]), ("b", "retry and retry again"), ("c", "nothing here"), ("d", None), ("e", ""), ("f", "window"))
    assert scores(S.bm25(now, "retry window", index=index)) == scores(S.bm25(now, "retry window"))
    index.remove(rows(spark, ("a", None)).select("id"))
    now = now.filter("id <> 'a'")
    assert scores(S.bm25(now, "retry window", index=index)) == scores(S.bm25(now, "retry window"))
    index.compact()
    assert len(index.segments()) == 1 and index.totals()[0] == 5
    assert scores(S.bm25(now, "retry window", index=index)) == scores(S.bm25(now, "retry window"))
    # a write that died is not seen, and its number is used again
    (tmp_path / "i/docs/seg=9").mkdir(parents=True)
    index.add(rows(spark, ("g", "retry")))
    assert index.totals()[0] == 6


def test_a_search_reads_the_buckets_of_its_terms_only(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), 64)
    index.add(rows(spark, *((f"r{i}", f"word{i} common") for i in range(200))))
    plan = index.postings(["word7"])._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters")[1][:200]
    assert index.postings(["word7"]).count() == 1
    assert "PushedFilters: [" in plan and "word7" in plan.split("PushedFilters")[1][:300]
