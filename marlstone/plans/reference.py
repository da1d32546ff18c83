"""Named queries over the test tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.functions.helpers import hash_vector
from marlstone.operators import assembly as A
from marlstone.operators import maintenance as M
from marlstone.operators import performance as P
from marlstone.operators import search as S
from marlstone.operators.text_index import TextIndex
from marlstone.session import scratch
from marlstone.sources import render
from marlstone.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUERY = "retry window"
VECTOR = hash_vector(QUERY)
_V = "[" + ", ".join(repr(x) for x in VECTOR) + "]::DOUBLE[]"
NOW = "2025-04-01 00:00:00"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RESCAN_AT = "2025-08-20 12:00:00"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "code_chunks")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "code_documents")


# ---- retrieval

def _bm25(where: str = "TRUE") -> str:
    tf = "len(list_filter(w, lambda x: x = '{}'))"
    t1, t2 = QUERY.split()
    return f"""
  tok AS (SELECT id, max(n) AS n, max(f1) AS f1, max(f2) AS f2, bool_or(keep) AS keep FROM (
     SELECT id, len(w) AS n, {tf.format(t1)} AS f1, {tf.format(t2)} AS f2, keep FROM (
       SELECT id, coalesce(({where}), FALSE) AS keep, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w FROM code_chunks)) GROUP BY id),
  st AS (SELECT count(*) AS total, avg(n) AS mean, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM tok),
  texts AS (SELECT id, round((CASE WHEN f1 > 0 THEN ln(1 + (total - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / mean)) ELSE 0 END)
       + (CASE WHEN f2 > 0 THEN ln(1 + (total - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * n / mean)) ELSE 0 END), 6) AS score FROM tok, st WHERE keep AND (f1 > 0 OR f2 > 0))"""


def _near(where: str = "TRUE") -> str:
    return f"""
  near AS (SELECT id, min(round(list_distance(embedding::DOUBLE[], {_V}), 6)) AS distance FROM code_chunks WHERE len(embedding) = 64 AND ({where}) GROUP BY id)"""


def _fused(where: str = "TRUE", pool: int = 100) -> str:
    return f"""WITH {_bm25(where)},{_near(where)},
  tr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM texts QUALIFY r <= {pool}),
  vr AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS r FROM near QUALIFY r <= {pool}),
  fused AS (SELECT id, round(coalesce(1 / (60.0::DOUBLE + tr.r), 0) + coalesce(1 / (60.0::DOUBLE + vr.r), 0), 9) AS score FROM tr FULL JOIN vr USING (id))"""


def _page(where: str, k: int) -> str:
    return f"{_fused(where)} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= {k}"


_INDEXED: dict[tuple[str, str], TextIndex] = {}


def text_index(spark, d) -> TextIndex:
    """The index of a folder's chunks, made once a session in the shared folder and used by all searches."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXED:
        index = TextIndex(spark, scratch(spark, "text-index"))
        index.add(chunks(spark, d))
        _INDEXED[key] = index
    return _INDEXED[key]


@query(f"WITH {_bm25()} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM texts QUALIFY rank <= 20")
def bm25_topk(spark, d):
    return S.top(S.bm25(chunks(spark, d), QUERY, index=text_index(spark, d)), F.desc("score"), 20)


@query("SELECT count(*) AS chunks, round(avg(n), 6) AS mean_words FROM (SELECT id, max(len(regexp_extract_all(lower(coalesce(content, '')), '[\\p{L}\\p{N}]+'))) AS n FROM code_chunks GROUP BY id)")
def text_index_totals(spark, d):
    """What the index knows without reading a posting; makes the index if it isn't there."""
    total, mean = text_index(spark, d).totals()
    return spark.createDataFrame([(total, round(float(mean), 6))], "chunks long, mean_words double")


@query(f"WITH {_bm25()} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM texts QUALIFY rank <= 20")
def bm25_scan_topk(spark, d):
    return S.top(S.bm25(chunks(spark, d), QUERY), F.desc("score"), 20)


@query(f"WITH {_near()} SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS rank FROM near QUALIFY rank <= 20")
def vector_topk_l2(spark, d):
    return S.top(S.vector_distances(chunks(spark, d), VECTOR), F.asc("distance"), 20)


def _search(spark, d, **o):
    return S.hybrid_search(chunks(spark, d), QUERY, VECTOR, S.SearchOptions(limit=10, **o), text_index(spark, d))


@query(_page("TRUE", 10))
def hybrid_search(spark, d):
    return _search(spark, d)


@query(_page("lower(language) IN ('python', 'rust')", 10))
def search_lang_filter(spark, d):
    return _search(spark, d, languages=["Python", "rust"])


@query(_page("node_type IN ('method')", 10))
def search_node_type_filter(spark, d):
    return _search(spark, d, node_types=["method"])


@query(_page("len(scope_path) BETWEEN 2 AND 5", 10))
def search_scope_depth_filter(spark, d):
    return _search(spark, d, scope_depth=(2, 5))


@query(_page("starts_with(file_path, 'src/')", 10))
def search_path_scope(spark, d):
    return _search(spark, d, path="src")


@query(_page("language = 'python' AND node_type IN ('function', 'method') AND len(scope_path) BETWEEN 1 AND 2", 10))
def search_combined_filters(spark, d):
    return _search(spark, d, languages=["python"], node_types=["function", "method"], scope_depth=(1, 2))


@query(f"""{_fused()},
  rows AS (SELECT DISTINCT f.id, f.score, c.project_id, c.file_path FROM fused f JOIN code_chunks c USING (id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY score DESC, id) AS chunk_rank, round(sum(score) OVER (PARTITION BY project_id, file_path), 6) AS file_score FROM rows),
  f AS (SELECT project_id, file_path FROM r WHERE chunk_rank = 1 ORDER BY file_score DESC, project_id, file_path LIMIT 10)
SELECT project_id, file_path, file_score, id, chunk_rank, score FROM r JOIN f USING (project_id, file_path) WHERE chunk_rank <= 3""")
def grouped_search(spark, d):
    return S.grouped_search(chunks(spark, d), QUERY, VECTOR, S.SearchOptions(limit=10, chunks_per_file=3), text_index(spark, d))


@query(_page("TRUE", 10).replace("SELECT id, score, row_number", "SELECT id, score, rank, round(CASE WHEN max(score) OVER () > 0 THEN score / max(score) OVER () * 100 ELSE 0 END, 6) AS relevance FROM (SELECT id, score, row_number") + ")")
def relevance_normalised(spark, d):
    return S.relevance_percent(_search(spark, d))


@query("SELECT DISTINCT id FROM code_chunks WHERE list_has_any(definitions, ['main', 'new', 'get_value', 'loadChunk']) OR node_name = 'loadChunk'")
def filter_definitions_or_name(spark, d):
    keep = S.metadata_filter(S.SearchOptions(has_definitions=["main", "new", "get_value", "loadChunk"])) | S.metadata_filter(S.SearchOptions(node_name="loadChunk"))
    return chunks(spark, d).filter(keep).select("id").distinct()


@query("SELECT DISTINCT id, parent_context FROM code_chunks WHERE parent_context IS NOT NULL AND len(symbol_refs) > 2")
def filter_references(spark, d):
    return chunks(spark, d).filter(F.col("parent_context").isNotNull() & (F.size("symbol_refs") > 2)).select("id", "parent_context").distinct()


# ---- timing analytics

PERF = r"""perf AS (SELECT event_id AS row_id, ts, list_extract(['rust', 'python', 'go', 'java', 'typescript'], CAST(user_id % 5 AS INT) + 1) AS language, k * k * k * 9 AS file_size, value AS duration_ms,
  CASE event_type WHEN 'click' THEN 'parser' WHEN 'view' THEN 'parser' WHEN 'signup' THEN 'tokenizer' ELSE 'process' END AS operation FROM (SELECT *, CAST(regexp_extract(props, '\d+') AS BIGINT) AS k FROM events))"""
BUCKET = ("CASE " + " ".join(f"WHEN file_size < {b} THEN '{x}'" for b, x in zip(C.SIZE_BOUNDS, C.SIZE_LABELS)) + f" ELSE '{C.SIZE_LABELS[-1]}' END")
ORDER = "CAST(list_position([" + ", ".join(f"'{x}'" for x in C.SIZE_LABELS) + "], bucket) AS BIGINT)"


def perf(spark: SparkSession, d: str) -> DataFrame:
    """The event log read as timing measurements."""
    k = F.regexp_extract("props", r"\d+", 0).cast("long")
    langs = F.array(*map(F.lit, ("rust", "python", "go", "java", "typescript")))
    op = F.when(F.col("event_type").isin("click", "view"), "parser").when(F.col("event_type") == "signup", "tokenizer").otherwise("process")
    return load(spark, d, "events").select(F.col("event_id").alias("row_id"), "ts", F.element_at(langs, (F.col("user_id") % 5 + 1).cast("int")).alias("language"),
                                           (k * k * k * 9).alias("file_size"), F.col("value").alias("duration_ms"), op.alias("operation"))


def _q(q: float, c: str = "duration_ms") -> str:
    return f"list_sort(list({c}))[CAST(floor((count({c}) - 1) * {q}::DOUBLE + 0.5) AS BIGINT) + 1]"


_STATS = "count(duration_ms) AS n, round(avg(duration_ms), 6) AS mean_ms, round(stddev_samp(duration_ms), 6) AS std_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms"


@query(f"WITH {PERF} SELECT language, {_STATS}, {_q(.5)} AS p50, {_q(.95)} AS p95, {_q(.99)} AS p99 FROM perf WHERE operation = 'parser' GROUP BY language")
def lang_perf_stats(spark, d):
    return P.language_stats(perf(spark, d), "parser")


@query(f"WITH {PERF} SELECT language, {_STATS}, {_q(.5)} AS p50, {_q(.95)} AS p95 FROM perf WHERE operation = 'tokenizer' GROUP BY language")
def tokenizer_perf_stats(spark, d):
    return P.language_stats(perf(spark, d), "tokenizer", p99=False)


@query(f"WITH {PERF} SELECT language, {_STATS} FROM perf WHERE operation = 'parser' GROUP BY language ORDER BY mean_ms DESC, language LIMIT 3")
def slowest_languages(spark, d):
    return P.slowest(P.stats_by(perf(spark, d).filter("operation = 'parser'"), ["language"], {}), 3)


@query(f"WITH {PERF}, b AS (SELECT *, {BUCKET} AS bucket FROM perf WHERE operation = 'parser') SELECT bucket, {_STATS}, {_q(.5)} AS p50, {_q(.95)} AS p95, {ORDER} AS bucket_order FROM b GROUP BY bucket")
def bucket_stats(spark, d):
    return P.bucket_stats(perf(spark, d), "parser")


@query(f"""WITH {PERF} SELECT CASE WHEN operation IN ('parser', 'tokenizer') THEN language || '_' || operation ELSE language END AS key, {BUCKET} AS bucket, count(*) AS n,
  round(sum(duration_ms), 6) AS total_ms, round(sum(duration_ms) / count(*), 6) AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms FROM perf GROUP BY 1, 2""")
def online_stats(spark, d):
    return P.online_stats(perf(spark, d))


@query(f"WITH {PERF}, b AS (SELECT *, {BUCKET} AS bucket FROM perf WHERE operation = 'parser') SELECT bucket, round(avg(CASE WHEN duration_ms > 0 THEN file_size / duration_ms END), 6) AS mean_bytes_per_ms, {ORDER} AS bucket_order FROM b GROUP BY bucket")
def throughput_by_bucket(spark, d):
    return P.throughput_by_bucket(perf(spark, d), "parser")


@query(f"WITH {PERF} SELECT language, count(*) AS files, round(avg(duration_ms), 6) AS mean_ms, CAST(sum(file_size) AS BIGINT) AS total_bytes, round(avg(file_size), 6) AS mean_bytes FROM perf GROUP BY language")
def proc_log_by_lang(spark, d):
    return P.log_by_language(perf(spark, d))


@query(f"WITH {PERF}, c AS (SELECT {_q(.95)} AS cut FROM perf WHERE operation = 'parser') SELECT language, {BUCKET} AS bucket, count(*) AS outliers FROM perf, c WHERE operation = 'parser' AND duration_ms > cut GROUP BY 1, 2")
def outliers_p95(spark, d):
    return P.outliers(perf(spark, d), "parser")


@query(f"""WITH {PERF}, a AS (SELECT language, file_size, avg(duration_ms) AS a FROM perf WHERE operation = 'parser' GROUP BY ALL), b AS (SELECT language, file_size, avg(duration_ms) AS b FROM perf WHERE operation = 'tokenizer' GROUP BY ALL),
  r AS (SELECT language, a / b AS ratio FROM a JOIN b USING (language, file_size) WHERE b > 0)
SELECT language, round(avg(ratio), 6) AS mean_ratio, round(stddev_samp(ratio), 6) AS std_ratio, round(max(ratio), 6) AS max_ratio, count(*) FILTER (ratio > 10) AS above_10 FROM r GROUP BY language""")
def parser_tokenizer_ratio(spark, d):
    return P.operation_ratio(perf(spark, d))


@query(f"""WITH {PERF}, t AS (SELECT *, round(file_size / duration_ms, 6) AS rate FROM perf WHERE operation = 'parser' AND duration_ms > 0), c AS (SELECT {_q(.1, 'rate')} AS cut FROM t)
SELECT row_id, language, file_size, duration_ms, rate FROM t, c WHERE rate < cut ORDER BY rate, row_id LIMIT 10""")
def slowest_p10(spark, d):
    return P.slow_tail(perf(spark, d), "parser")


_OPS = ("parser", "tokenizer", "process")


@query(f"WITH {PERF} SELECT language, " + ", ".join(f"round(avg(duration_ms) FILTER (operation = '{o}'), 6) AS {o}" for o in _OPS) + " FROM perf GROUP BY language")
def pivot_mean(spark, d):
    return P.mean_pivot(perf(spark, d), "operation", list(_OPS))


@query(f"WITH {PERF} SELECT row_id, language, ts, row_number() OVER (PARTITION BY language ORDER BY ts, row_id) AS files_so_far FROM perf")
def cumulative_files(spark, d):
    return P.running_files(perf(spark, d))


# ---- change detection and table maintenance

NEWEST = """nd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY indexed_at DESC, id DESC) AS r FROM code_documents) WHERE r = 1)"""
SEEN = """ns AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY observed_at DESC, scan_id DESC) AS r FROM file_scans) WHERE r = 1)"""


def newest_documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    keep = dict.fromkeys(["project_id", "file_path", "indexed_at", "id", *columns])
    return M.newest(docs(spark, d).select(*keep), ["project_id", "file_path"], ["indexed_at", "id"])


def newest_scans(spark: SparkSession, d: str) -> DataFrame:
    return M.newest(load(spark, d, "file_scans"), ["project_id", "file_path"], ["observed_at", "scan_id"])


@query(f"WITH {NEWEST}, {SEEN} SELECT ns.project_id, ns.file_path, ns.operation FROM ns LEFT JOIN nd USING (project_id, file_path) WHERE ns.operation <> 'Delete' AND (nd.id IS NULL OR nd.content_hash IS DISTINCT FROM ns.content_hash)")
def changed_files(spark, d):
    return M.changed_only(newest_scans(spark, d).filter("operation != 'Delete'"), newest_documents(spark, d, "content_hash")).select("project_id", "file_path", "operation")


@query(f"WITH {NEWEST}, {SEEN} SELECT count(*) FILTER (nd.content_hash = ns.content_hash) AS files, CAST(coalesce(sum(ns.file_size) FILTER (nd.content_hash = ns.content_hash), 0) AS BIGINT) AS bytes FROM ns LEFT JOIN nd USING (project_id, file_path)")
def skipped_files(spark, d):
    return M.skipped(newest_scans(spark, d), newest_documents(spark, d, "content_hash"))


@query(f"WITH {SEEN} SELECT DISTINCT project_id, file_path FROM code_documents d WHERE NOT EXISTS (SELECT 1 FROM ns WHERE ns.project_id = d.project_id AND ns.file_path = d.file_path AND operation <> 'Delete')")
def deleted_files(spark, d):
    return M.gone(docs(spark, d), newest_scans(spark, d).filter("operation != 'Delete'"))


@query(f"WITH {NEWEST}, f AS (SELECT DISTINCT project_id, file_path FROM file_scans WHERE operation = 'Delete') SELECT id, project_id, file_path FROM nd WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.project_id = nd.project_id AND f.file_path = nd.file_path)")
def cascade_delete(spark, d):
    deleted = load(spark, d, "file_scans").filter("operation = 'Delete'")
    return M.cascade_delete(deleted, newest_documents(spark, d))[0].select("id", "project_id", "file_path")


@query("""WITH o AS (SELECT id, project_id, file_path, indexed_at, row_number() OVER (PARTITION BY project_id, file_path ORDER BY indexed_at, id) AS r, row_number() OVER (PARTITION BY project_id, file_path ORDER BY indexed_at DESC, id DESC) AS z
  FROM (SELECT DISTINCT id, project_id, file_path, indexed_at FROM code_documents))
SELECT id, project_id, file_path FROM o WHERE z = 1""")
def upsert_docs(spark, d):
    rows = docs(spark, d).select("id", "project_id", "file_path", "indexed_at").distinct()
    first = rows.groupBy("project_id", "file_path").agg(F.min(F.struct("indexed_at", "id")).alias("m")).select("project_id", "file_path", "m.*")
    new = M.newest(rows, M.KEY, ["indexed_at", "id"])
    return M.upsert(first.select("id", "project_id", "file_path"), new.select("id", "project_id", "file_path"), M.KEY)


@query("""WITH c AS (SELECT DISTINCT id, project_id, file_path, start_byte FROM code_chunks), n AS (SELECT * FROM c WHERE start_byte = 0)
SELECT id, project_id, file_path FROM c WHERE EXISTS (SELECT 1 FROM n WHERE n.project_id = c.project_id AND n.file_path = c.file_path) AND NOT EXISTS (SELECT 1 FROM n WHERE n.id = c.id)""")
def stale_prune(spark, d):
    c = chunks(spark, d).select("id", "project_id", "file_path", "start_byte").distinct()
    return M.stale(c, c.filter("start_byte = 0")).select("id", "project_id", "file_path")


@query("""WITH p AS (SELECT id, directory FROM projects), x AS (SELECT DISTINCT path AS path FROM index_tasks UNION SELECT DISTINCT path || '/src/a.py' FROM index_tasks)
SELECT path, id AS project_id, directory FROM (SELECT path, id, directory, row_number() OVER (PARTITION BY path ORDER BY length(directory) DESC) AS r FROM x JOIN p ON path = directory OR starts_with(path, directory || '/')) WHERE r = 1""")
def longest_prefix_project(spark, d):
    t = load(spark, d, "index_tasks").select("path").distinct()
    paths = t.union(t.select(F.concat("path", F.lit("/src/a.py")))).distinct()
    return M.covering_folder(paths, load(spark, d, "projects").select("id", "directory")).select("path", F.col("id").alias("project_id"), "directory")


@query("""WITH x AS (SELECT DISTINCT project_id, regexp_replace(file_path, '/[^/]*$', '') AS path FROM code_documents WHERE file_path LIKE 'src/%'), s AS (SELECT DISTINCT project_id, file_path FROM code_documents)
SELECT DISTINCT x.project_id, coalesce(s.file_path, x.path) AS file_path FROM x LEFT JOIN s ON s.project_id = x.project_id AND (s.file_path = x.path OR starts_with(s.file_path, x.path || '/'))""")
def dir_expand(spark, d):
    gone = docs(spark, d).filter(F.col("file_path").startswith("src/")).select("project_id", F.regexp_replace("file_path", "/[^/]*$", "").alias("path"))
    return M.expand_deletes(gone, docs(spark, d))


@query("SELECT DISTINCT p.id AS project_id, t.path FROM index_tasks t JOIN projects p ON p.id = t.project_id WHERE t.path = p.directory OR starts_with(t.path, p.directory || '/')")
def in_project(spark, d):
    t = load(spark, d, "index_tasks").select("project_id", "path").distinct()
    return M.in_project(t, load(spark, d, "projects"))


# ---- assembly

@query(f"WITH {NEWEST}, c AS (SELECT file_id AS id, count(DISTINCT id) AS received FROM code_chunks GROUP BY 1) SELECT nd.id AS file_id, coalesce(received, 0) AS received, CAST(chunk_count AS BIGINT) AS expected, coalesce(coalesce(received, 0) = chunk_count, FALSE) AS complete FROM nd LEFT JOIN c USING (id)")
def file_completeness(spark, d):
    c = chunks(spark, d).select(F.col("file_id"), "id").distinct()
    ends = newest_documents(spark, d, "chunk_count").select(F.col("id").alias("file_id"), F.col("chunk_count").alias("expected_chunks"))
    return A.completeness(c.join(ends.select("file_id"), "file_id", "left_semi"), ends, ["file_id"])


_CHUNK1 = "c AS (SELECT id, any_value(file_id) AS file_id, any_value(language) AS language, any_value(content) AS content, any_value(project_id) AS project_id, any_value(file_path) AS file_path FROM code_chunks GROUP BY id)"


def one_row_chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return chunks(spark, d).select("id", *columns).dropDuplicates(["id"])


@query(f"WITH {_CHUNK1} SELECT file_id, language, CAST(sum(strlen(content) // 4) AS BIGINT) AS weight FROM c GROUP BY file_id, language")
def language_weights(spark, d):
    # the texts stay where they are: only their sizes are shuffled
    rows = chunks(spark, d).select("id", "file_id", "language", C.token_estimate("content").alias("w")).dropDuplicates(["id"])
    return rows.groupBy("file_id", "language").agg(F.sum("w").alias("weight"))


@query(f"WITH {_CHUNK1}, w AS (SELECT project_id, language, CAST(sum(strlen(content) // 4) AS BIGINT) AS weight FROM c GROUP BY 1, 2) SELECT project_id, string_agg(language, ',' ORDER BY weight DESC, language) AS languages, first(language ORDER BY weight DESC, language) AS primary_language FROM w GROUP BY project_id")
def language_list(spark, d):
    rows = chunks(spark, d).select("id", "project_id", "language", C.token_estimate("content").alias("w")).dropDuplicates(["id"])
    w = rows.groupBy("project_id", "language").agg(F.sum("w").alias("weight"))
    return A.file_languages(w, ["project_id"]).select("project_id", F.array_join("languages", ",").alias("languages"), "primary_language")


@query("SELECT count(file_size) AS files, CAST(sum(file_size) AS BIGINT) AS total, max(file_size) AS largest, min(file_size) AS smallest FROM code_documents")
def corpus_size_summary(spark, d):
    return A.corpus_size(docs(spark, d), "file_size")


@query("WITH p AS (SELECT project_id, file_path, count(*) AS c FROM code_chunks GROUP BY ALL) SELECT count(*) AS files, CAST(sum(c) AS BIGINT) AS chunks, round(avg(c), 6) AS mean_chunks, max(c) AS most_chunks FROM p")
def chunk_directory_summary(spark, d):
    return A.chunk_summary(chunks(spark, d), ["project_id", "file_path"])


@query("SELECT id, row_number() OVER (PARTITION BY file_id ORDER BY start_byte, id) AS ordinal, 'chunk_' || row_number() OVER (PARTITION BY file_id ORDER BY start_byte, id) AS default_name FROM (SELECT DISTINCT id, file_id, start_byte FROM code_chunks)")
def chunk_ordinals(spark, d):
    rows = chunks(spark, d).select("id", "file_id", "start_byte").distinct()
    return M.ordinals(rows, ["file_id"], ["start_byte", "id"]).select("id", "ordinal", "default_name")


@query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 256 AS batch_id FROM documents")
def fixed_batches(spark, d):
    return A.fixed_batches(load(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"]).select("doc_id", "batch_id")


@query()
def token_batches(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "source", C.token_estimate("text").alias("tokens"))
    # the groups are upstream batches of a fixed number of rows, so none grows with a source
    up = A.fixed_batches(rows, ["source"], ["doc_id"]).withColumnRenamed("batch_id", "upstream")
    return A.token_batches(up, ["source", "upstream"], ["doc_id"], "tokens", 128, 8_000)


@query("SELECT id, unnest(list_sort(list_distinct(failed_files))) AS file FROM failed_embedding_batches")
def failed_files(spark, d):
    return load(spark, d, "failed_embedding_batches").select("id", F.explode(C.sorted_set("failed_files")).alias("file"))


@query("WITH f AS (SELECT DISTINCT project_id, unnest(failed_files) AS f FROM failed_embedding_batches) SELECT project_id, string_agg(f, '|' ORDER BY f) AS files, count(*) || ' files failed' AS message FROM f GROUP BY project_id")
def failed_summary(spark, d):
    return A.failed_summary(load(spark, d, "failed_embedding_batches"), ["project_id"]).select("project_id", F.array_join("files", "|").alias("files"), "message")


@query("WITH f AS (SELECT DISTINCT project_id, unnest(failed_files) AS file_path FROM failed_embedding_batches) SELECT DISTINCT id FROM code_chunks c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.project_id = c.project_id AND f.file_path = c.file_path)")
def without_failed(spark, d):
    f = load(spark, d, "failed_embedding_batches").select("project_id", F.explode("failed_files").alias("file_path"))
    return A.without_failed(chunks(spark, d).select("id", "project_id", "file_path"), f, M.KEY).select("id").distinct()


@query("SELECT id, string_agg(s, ',' ORDER BY s) AS symbols FROM (SELECT DISTINCT id, unnest(list_concat(definitions, symbol_refs)) AS s FROM code_chunks) WHERE s IS NOT NULL GROUP BY id")
def symbol_sets(spark, d):
    s = C.sorted_set(F.concat(F.coalesce("definitions", F.array().cast("array<string>")), F.coalesce("symbol_refs", F.array().cast("array<string>"))))
    rows = chunks(spark, d).select("id", F.explode(s).alias("s")).distinct()
    return rows.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("s")), ",").alias("symbols"))


# ---- scalars

@query("SELECT doc_id, strlen(text) // 4 AS tokens, strlen(text) AS bytes FROM documents")
def token_estimate(spark, d):
    return load(spark, d, "documents").select("doc_id", C.token_estimate("text").alias("tokens"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT count(*) AS rows, count(DISTINCT sha256(text)) AS texts, count(DISTINCT text) AS same FROM documents")
def dedup_hash(spark, d):
    t = load(spark, d, "documents").select("text", C.content_digest("text").alias("h"))
    return t.agg(F.count("*").alias("rows"), F.countDistinct("h").alias("texts"), F.countDistinct("text").alias("same"))


_HALF = "CAST(strlen(text) // 2 AS BIGINT)"
_PRE = "encode(text)[1:{}]"


@query(f"""WITH x AS (SELECT doc_id, {_HALF} AS o, hex(encode(text)) AS h FROM documents),
  y AS (SELECT doc_id, o, regexp_replace(substr(h, 1, 2 * o), '(..)', '\\1 ', 'g') AS a, CASE WHEN o > 1 THEN regexp_replace(substr(h, 1, 2 * (o - 1)), '(..)', '\\1 ', 'g') ELSE '' END AS b FROM x)
SELECT doc_id, o AS byte_offset, 1 + (length(a) - length(replace(a, '0A ', ''))) // 3 AS line_true, 1 + CAST(o > 0 AS INT) + (length(b) - length(replace(b, '0A ', ''))) // 3 AS line_compat FROM y""")
def line_numbers(spark, d):
    rows = load(spark, d, "documents").select("doc_id", "text", F.floor(F.octet_length("text") / 2).cast("int").alias("o"))
    return rows.select("doc_id", F.col("o").cast("long").alias("byte_offset"), C.line_true("text", "o").alias("line_true"), C.line_compat("text", "o").alias("line_compat"))


@query(f"SELECT {BUCKET} AS bucket, count(*) AS files FROM code_documents GROUP BY 1")
def size_buckets(spark, d):
    return docs(spark, d).groupBy(C.size_bucket("file_size").alias("bucket")).agg(F.count("*").alias("files"))


@query("SELECT DISTINCT file_path, translate(file_path, '/ ', '__') AS name FROM code_documents")
def safe_names(spark, d):
    return docs(spark, d).select("file_path", C.safe_name("file_path").alias("name")).distinct()


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS first FROM embeddings")
def unit_vectors(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.round(C.norm2("embedding"), 5).alias("norm"), F.round(F.element_at(C.unit_vector("embedding"), 1), 5).alias("first"))


@query("SELECT count(*) AS rows, count(*) FILTER (regexp_full_match(id, '[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}')) AS valid FROM code_documents")
def uuid_check(spark, d):
    return docs(spark, d).agg(F.count("*").alias("rows"), F.sum(C.is_uuid("id").cast("long")).alias("valid"))


@query("SELECT project_id || chr(9) || file_path || chr(9) || coalesce(CAST(file_size AS VARCHAR), '') AS line FROM code_documents")
def tsv_lines(spark, d):
    return render.tsv_lines(docs(spark, d), ["project_id", "file_path", "file_size"])


# ---- tasks as data

@query("""WITH x AS (SELECT project_id, unnest(from_json(json_extract(task_type, '$.PartialUpdate.changes'), '[{"path": "VARCHAR", "operation": "VARCHAR"}]')) AS c FROM index_tasks WHERE task_type LIKE '{%'),
  y AS (SELECT DISTINCT project_id, c.path AS path, c.operation AS operation FROM x)
SELECT project_id, string_agg(path || ':' || operation, ',' ORDER BY path, operation) AS changes FROM y GROUP BY project_id""")
def merge_partial_changes(spark, d):
    out = M.merge_changes(load(spark, d, "index_tasks"), ["project_id"])
    return out.select("project_id", F.array_join(F.transform("changes", lambda c: F.concat(c["path"], F.lit(":"), c["operation"])), ",").alias("changes"))


@query("SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM index_tasks QUALIFY rank <= 20")
def latest_tasks(spark, d):
    rows = load(spark, d, "index_tasks").select("id", "created_at").orderBy(F.desc("created_at"), "id").limit(20)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("created_at"), "id")).cast("long"))


@query("SELECT status, count(*) AS tasks, count(DISTINCT project_id) AS projects, CAST(coalesce(sum(files_indexed), 0) AS BIGINT) AS files FROM index_tasks GROUP BY status")
def task_counts(spark, d):
    return load(spark, d, "index_tasks").groupBy("status").agg(F.count("*").alias("tasks"), F.countDistinct("project_id").alias("projects"), F.coalesce(F.sum("files_indexed"), F.lit(0)).alias("files"))


@query(f"SELECT id, retry_count, list_extract([1, 5, 10, 20, 40, 60], CAST(least(greatest(retry_count, 0), 5) AS INT) + 1)::BIGINT AS minutes FROM failed_embedding_batches WHERE retry_after <= TIMESTAMP '{NOW}'")
def due_retry(spark, d):
    due = M.due_retries(load(spark, d, "failed_embedding_batches"), F.lit(NOW).cast("timestamp_ntz"))
    return due.select("id", "retry_count", C.retry_delay("retry_count").alias("minutes"))


@query("WITH x AS (SELECT id, unnest(from_json(errors, '[{\"timestamp\": \"VARCHAR\", \"error\": \"VARCHAR\"}]')) AS e FROM failed_embedding_batches) SELECT e.error AS error, count(*) AS times, count(DISTINCT id) AS batches FROM x GROUP BY 1")
def error_counts(spark, d):
    e = F.from_json("errors", "array<struct<timestamp:string,error:string>>")
    rows = load(spark, d, "failed_embedding_batches").select("id", F.explode(e).alias("e"))
    return rows.groupBy(F.col("e.error").alias("error")).agg(F.count("*").alias("times"), F.countDistinct("id").alias("batches"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
  n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS since, max(ts) + INTERVAL 30 MINUTE AS until, count(*) AS events FROM n GROUP BY user_id, k""")
def debounce_sessions(spark, d):
    from marlstone.streaming.jobs import sessions

    out = sessions(load(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp")), ["user_id"], "t", "30 minutes")
    return out.select("user_id", F.col("since").cast("timestamp_ntz").alias("since"), F.col("until").cast("timestamp_ntz").alias("until"), "events")


@query(f"SELECT id FROM projects WHERE status = 'Active' AND rescan_interval IS NOT NULL AND (last_indexed_at IS NULL OR epoch_us(last_indexed_at) + rescan_interval <= epoch_us(TIMESTAMP '{RESCAN_AT}'))")
def due_rescan(spark, d):
    return M.due_rescans(load(spark, d, "projects"), F.lit(RESCAN_AT).cast("timestamp_ntz")).select("id")


@query("SELECT id, updated_at, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM projects QUALIFY rank <= 10")
def newest_projects(spark, d):
    rows = load(spark, d, "projects").select("id", "updated_at", "created_at").orderBy(F.desc("created_at"), "id").limit(10)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("created_at"), "id")).cast("long")).drop("created_at")


@query("SELECT id, created_at FROM index_tasks WHERE status = 'pending' ORDER BY created_at, id LIMIT 1")
def oldest_pending(spark, d):
    return load(spark, d, "index_tasks").filter("status = 'pending'").select("id", "created_at").orderBy("created_at", "id").limit(1)


@query("SELECT id, name, directory FROM projects WHERE directory = (SELECT min(directory) FROM projects)")
def point_lookup(spark, d):
    rows = load(spark, d, "projects")
    return rows.filter(F.col("directory") == rows.agg(F.min("directory")).first()[0]).select("id", "name", "directory")


@query("SELECT EXISTS (SELECT 1 FROM index_tasks WHERE status = 'running') AS running, EXISTS (SELECT 1 FROM index_tasks WHERE status = 'nowhere') AS nowhere")
def existence(spark, d):
    rows = load(spark, d, "index_tasks")
    some = lambda s: not rows.filter(F.col("status") == s).isEmpty()
    return spark.createDataFrame([(some("running"), some("nowhere"))], "running boolean, nowhere boolean")


@query("SELECT count(*) AS n FROM code_chunks WHERE project_id <> '00000000-0000-0000-0000-000000000000' AND language = 'rust'")
def filtered_count(spark, d):
    return chunks(spark, d).filter(C.no_sentinel("project_id") & (F.col("language") == "rust")).agg(F.count("*").alias("n"))


@query("""SELECT d.n AS documents_rows, d.u AS documents, d.b AS documents_bytes, c.n AS chunks_rows, c.u AS chunks, c.b AS chunks_bytes
FROM (SELECT count(*) AS n, count(DISTINCT id) AS u, CAST(sum(strlen(content)) AS BIGINT) AS b FROM code_documents) d, (SELECT count(*) AS n, count(DISTINCT id) AS u, CAST(sum(strlen(content)) AS BIGINT) AS b FROM code_chunks) c""")
def run_counters(spark, d):
    return M.run_counters(docs(spark, d), chunks(spark, d))


@query("SELECT kind, count(*) AS n, count(DISTINCT project_id) AS projects FROM (SELECT 'stored' AS kind, project_id, file_path FROM code_documents UNION ALL SELECT 'seen', project_id, file_path FROM file_scans) GROUP BY kind")
def union_of_batches(spark, d):
    part = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "project_id", "file_path")
    both = part(docs(spark, d), "stored").unionByName(part(load(spark, d, "file_scans"), "seen"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("project_id").alias("projects"))


@query("SELECT project_id, file_path FROM code_documents INTERSECT SELECT project_id, file_path FROM file_scans WHERE operation = 'Delete'")
def stored_and_deleted(spark, d):
    return docs(spark, d).select("project_id", "file_path").intersect(load(spark, d, "file_scans").filter("operation = 'Delete'").select("project_id", "file_path"))


@query("SELECT status, status IN ('pending', 'running', 'completed', 'partially_completed', 'failed', 'merged') AS known, count(*) AS tasks FROM (SELECT status FROM index_tasks UNION ALL SELECT status FROM projects) GROUP BY ALL")
def known_states(spark, d):
    rows = load(spark, d, "index_tasks").select("status").unionByName(load(spark, d, "projects").select("status"))
    return rows.groupBy("status", C.known_state("status").alias("known")).agg(F.count("*").alias("tasks"))


@query("""SELECT id, chr(39) || replace(coalesce(description, name) || chr(39) || 's', chr(39), chr(39) || chr(39)) || chr(39) AS literal FROM projects""")
def quoted_literals(spark, d):
    rows = load(spark, d, "projects").select("id", F.concat(F.coalesce("description", "name"), F.lit("'s")).alias("t"))
    return rows.select("id", C.quoted("t").alias("literal"))


@query("""SELECT id, replace(replace(task_type, '": ', '":'), ', "', ',"') AS task_type FROM index_tasks WHERE task_type LIKE '{%'""")
def task_json_round_trip(spark, d):
    rows = load(spark, d, "index_tasks").filter(~M.is_full()).select("id", M.task_changes().alias("changes")).filter("changes is not null")
    return rows.select("id", F.replace(M.encoded_changes("changes"), F.lit("},{"), F.lit("}, {")).alias("task_type"))


def _first_project(spark, d) -> str:
    return chunks(spark, d).agg(F.min("project_id")).first()[0]


@query(_page("project_id = (SELECT min(project_id) FROM code_chunks)", 10))
def search_project_scope(spark, d):
    return _search(spark, d, project_id=_first_project(spark, d))


@query(_page("parent_context = (SELECT min(parent_context) FROM code_chunks)", 10))
def search_parent_context(spark, d):
    return _search(spark, d, parent_context=chunks(spark, d).agg(F.min("parent_context")).first()[0])


# ---- rows without an SQL counterpart: tested against invariants

@query()
def chunk_text(spark, d):
    from marlstone.operators.chunking import chunk_files

    return chunk_files(load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "project_id", F.col("doc_path").alias("file_path"), F.col("text").alias("content")), 1000, text_only=True)


@query()
def chunk_code(spark, d):
    from marlstone.operators.chunking import chunk_files

    return chunk_files(newest_documents(spark, d, "content"), 1500)


def _torn(files: DataFrame, pieces: DataFrame, key: str = "file_id") -> DataFrame:
    """One row: files with chunks, and those whose chunks, put together in order, aren't the file or have wrong byte places."""
    at = F.col("start_byte") != F.col("expected")
    w = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("size", F.octet_length("content")).withColumn("expected", F.coalesce(F.sum("size").over(w), F.lit(0)))
    whole = placed.groupBy(key).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "content"))), lambda c: c["content"]), ""), 256).alias("h"),
                                    F.max(at | (F.col("end_byte") - F.col("start_byte") != F.col("size"))).alias("off"))
    both = files.select(F.col("id").alias(key), F.sha2("content", 256).alias("own")).join(whole, key)
    return both.agg(F.count("*").alias("files"), F.coalesce(F.sum((F.col("off") | (F.col("h") != F.col("own"))).cast("long")), F.lit(0)).alias("torn"))


@query("SELECT count(*) AS files, 0::BIGINT AS torn FROM documents WHERE length(text) > 0")
def chunk_text_sound(spark, d):
    return _torn(load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content")), chunk_text(spark, d))


@query("SELECT count(*) AS files, 0::BIGINT AS torn FROM (SELECT arg_max(content, (indexed_at, id)) AS content FROM code_documents GROUP BY project_id, file_path) WHERE length(content) > 0")
def chunk_code_sound(spark, d):
    return _torn(newest_documents(spark, d, "content"), chunk_code(spark, d))


@query("SELECT count(*) AS documents, 0::BIGINT AS wrong FROM documents WHERE length(text) > 0")
def chunk_tokens_sound(spark, d):
    """Chunks by tokens of a public vocabulary: no chunk above the limit, ids kept, and no file left out."""
    from marlstone.operators.chunking import chunk_files

    files = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "project_id", F.col("doc_path").alias("file_path"), F.col("text").alias("content"))
    rows = chunk_files(files, 256, text_only=True, vocabulary=VOCABULARY)
    return rows.agg(F.count_distinct("file_id").alias("documents"), F.sum((~F.size("token_ids").between(1, 256)).cast("long")).alias("wrong"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS documents, 0::BIGINT AS above, FALSE AS loose FROM documents GROUP BY source")
def token_batches_sound(spark, d):
    """Batches in order: none above a limit but for single items, and no batch that would have had room for the next one's first item."""
    rows = token_batches(spark, d)
    by = ["source", "upstream", "batch_id"]
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.min_by("tokens", "doc_id").alias("first"))
    above = (F.col("n") > 128) | (F.col("t") > 8_000) & (F.col("n") > 1)
    nxt = F.lead("first").over(Window.partitionBy("source", "upstream").orderBy("batch_id"))
    checked = sums.withColumn("above", above.cast("long")).withColumn("loose", F.coalesce((F.col("n") < 128) & (F.col("t") + nxt <= 8_000), F.lit(False)))
    return checked.groupBy("source").agg(F.sum("n").alias("documents"), F.sum("above").alias("above"), F.max("loose").alias("loose"))


@query("SELECT count(*) AS documents, 0::BIGINT AS wrong FROM documents WHERE text IS NOT NULL")
def hash_embed_sound(spark, d):
    """One vector of the right width for every text, between 0 and 1, equal for equal texts."""
    rows = hash_embed(spark, d).filter("embedding is not null")
    wrong = (F.size("embedding") != 64) | F.exists("embedding", lambda x: ~x.between(0.0, 1.0)) | F.col("embed_error").isNotNull()
    return rows.agg(F.count("*").alias("documents"), F.sum(wrong.cast("long")).alias("wrong"))


@query("SELECT count(DISTINCT id) AS chunks, 0::BIGINT AS wrong FROM code_chunks WHERE content IS NOT NULL")
def token_embed_sound(spark, d):
    """One vector of length 1 (or 0, where there are no words) for every chunk."""
    rows = token_embed(spark, d).filter("embedding is not null")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    wrong = (F.size("embedding") != 64) | ~((F.abs(length - 1) < 1e-3) | (length == 0))
    return rows.agg(F.count("*").alias("chunks"), F.sum(wrong.cast("long")).alias("wrong"))


@query()
def hash_embed(spark, d):
    from marlstone.operators.embedding import embed, provider

    return embed(load(spark, d, "documents").select("doc_id", F.col("text").alias("content")), provider("hash", width=64)).select("doc_id", "embedding", "embed_error")


@query()
def token_embed(spark, d):
    from marlstone.operators.embedding import embed, provider

    # vectors are shuffled, not texts: repeated rows go after they are embedded
    rows = embed(chunks(spark, d).select("id", "content"), provider("tokens", width=64)).select("id", "embedding", "embed_error")
    return rows.dropDuplicates(["id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
