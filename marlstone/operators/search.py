"""Hybrid retrieval: metadata filters, BM25, exact vector ranking, reciprocal rank fusion.

Statistics of BM25 (number of chunks, their mean length, document frequencies) come from the whole
table in one aggregation that yields one row; filters then narrow the candidates before each list is
ranked and cut. Only the counts of the query's terms leave the scan, never texts. With a kept index (``TextIndex``) texts
aren't read at all, only the postings of the query's terms.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.operators.text_index import TextIndex

K1, B = 1.2, 0.75
RRF_K = 60


@dataclass
class SearchOptions:
    """Empty lists and None don't filter; options combine by AND, values of one list by OR."""

    languages: list[str] = field(default_factory=list)
    node_types: list[str] = field(default_factory=list)
    node_name: str | None = None
    parent_context: str | None = None
    scope_depth: tuple[int, int] | None = None
    has_definitions: list[str] = field(default_factory=list)
    has_references: list[str] = field(default_factory=list)
    project_id: str | None = None
    path: str | None = None
    #: Names and contexts as regular expressions rather than whole values.
    patterns: bool = False
    limit: int = 5
    chunks_per_file: int = 3
    pool: int = 100


def metadata_filter(o: SearchOptions, references: str = "symbol_refs") -> Column:
    """One predicate; every part can be pushed to the scan or is evaluated before any ranking."""
    match = (lambda c, v: F.col(c).rlike(v)) if o.patterns else (lambda c, v: F.col(c) == v)
    out = F.lit(True)
    if o.project_id:
        out &= F.col("project_id") == o.project_id
    if o.path:
        out &= C.under_path("file_path", o.path)
    if o.languages:
        out &= F.lower("language").isin([x.lower() for x in o.languages])
    if o.node_types:
        out &= F.col("node_type").isin(o.node_types)
    if o.node_name is not None:
        out &= match("node_name", o.node_name)
    if o.parent_context is not None:
        out &= match("parent_context", o.parent_context)
    if o.scope_depth:
        out &= F.coalesce(F.size("scope_path"), F.lit(0)).between(*o.scope_depth)
    if o.has_definitions:
        out &= F.arrays_overlap("definitions", F.array(*map(F.lit, o.has_definitions)))
    if o.has_references:
        out &= F.arrays_overlap(references, F.array(*map(F.lit, o.has_references)))
    return out


def query_terms(query: str) -> list[str]:
    import regex

    return list(dict.fromkeys(regex.findall(r"[\p{L}\p{N}]+", query.lower())))


def _equals(term: str):
    return lambda w: w == F.lit(term)


def _score(terms: int) -> Column:
    """BM25 of the columns _f0, _f1, … (in the row), _d0, _d1, … (in all rows), _n, _total and _mean."""
    score = F.lit(0.0)
    for i in range(terms):
        f, d = F.col(f"_f{i}"), F.col(f"_d{i}")
        idf = F.log(1 + (F.col("_total") - d + 0.5) / (d + 0.5))
        score += F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.col("_mean")))).otherwise(0.0)
    return F.round(score, 6).alias("score")


def bm25_from(index: TextIndex, query: str, keep: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(id, score) from a kept index; ``keep`` has the ids that may come out."""
    terms = query_terms(query)
    total, mean = index.totals() if terms else (0, 0.0)
    if not total:
        return index.spark.createDataFrame([], f"{key} string, score double")
    found = index.postings(terms)
    rows = found.groupBy("id").agg(F.max("n").alias("_n"), *[F.coalesce(F.max(F.when(F.col("term") == t, F.col("f"))), F.lit(0)).alias(f"_f{i}") for i, t in enumerate(terms)])
    stats = rows.agg(*[F.sum((F.col(f"_f{i}") > 0).cast("long")).alias(f"_d{i}") for i in range(len(terms))])
    kept = rows.join(keep.select(F.col(key).cast("string").alias("id")).distinct(), "id", "left_semi") if keep is not None else rows
    # the statistics are a single row by construction
    return (kept.crossJoin(F.broadcast(stats)).withColumn("_total", F.lit(total)).withColumn("_mean", F.lit(mean))
            .select(F.col("id").alias(key), _score(len(terms))))


def bm25(chunks: DataFrame, query: str, keep: Column | None = None, text: str = "content", key: str = "id", index: TextIndex | None = None) -> DataFrame:
    """(id, score) of the chunks that hold a term. Repeated rows of an id count once; a null text has no terms."""
    terms = query_terms(query)
    if not terms:
        return chunks.sparkSession.createDataFrame([], f"{key} string, score double")
    if index is not None:
        return bm25_from(index, query, chunks.filter(keep).select(key) if keep is not None else None, key)
    tf = [F.size(F.filter("_w", _equals(t))).alias(f"_f{i}") for i, t in enumerate(terms)]
    rows = (chunks.withColumn("_keep", F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True))
            .select(F.col(key).cast("string").alias(key), "_keep", C.words(F.coalesce(F.col(text), F.lit(""))).alias("_w")).select(key, "_keep", F.size("_w").alias("_n"), *tf)
            .groupBy(key).agg(F.max("_keep").alias("_keep"), F.max("_n").alias("_n"), *[F.max(f"_f{i}").alias(f"_f{i}") for i in range(len(terms))]))
    stats = rows.agg(F.count("*").alias("_total"), F.avg("_n").alias("_mean"), *[F.sum((F.col(f"_f{i}") > 0).cast("long")).alias(f"_d{i}") for i in range(len(terms))])
    hit = F.greatest(*[F.col(f"_f{i}") for i in range(len(terms))], F.lit(0)) > 0
    # the statistics are a single row by construction
    return rows.filter(F.col("_keep") & hit).crossJoin(F.broadcast(stats)).select(key, _score(len(terms)))


def vector_distances(chunks: DataFrame, vector: list[float], keep: Column | None = None, column: str = "embedding", key: str = "id") -> DataFrame:
    """(id, distance): Euclidean, over vectors of the query's width."""
    rows = chunks.filter(keep) if keep is not None else chunks
    return (rows.filter(F.size(column) == len(vector)).select(F.col(key).cast("string").alias(key), F.round(C.l2_distance(column, vector), 6).alias("distance"))
            .groupBy(key).agg(F.min("distance").alias("distance")))


def top(rows: DataFrame, by: Column, k: int, key: str = "id") -> DataFrame:
    """The first k rows with their ranks from 1; ties by key. At most k rows reach the window."""
    cut = rows.orderBy(by, F.col(key)).limit(k)
    return cut.withColumn("rank", F.row_number().over(Window.orderBy(by, F.col(key))).cast("long"))


def fuse(texts: DataFrame, vectors: DataFrame, k: int = RRF_K, key: str = "id") -> DataFrame:
    """(id, score): reciprocal rank fusion of two ranked lists."""
    t, v = texts.select(key, F.col("rank").alias("_rt")), vectors.select(key, F.col("rank").alias("_rv"))
    part = lambda c: F.coalesce(1 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    return t.join(v, key, "full_outer").select(key, F.round(part("_rt") + part("_rv"), 9).alias("score"))


def _kept(o: SearchOptions) -> Column | None:
    """The filter of the options, if they have any."""
    plain = SearchOptions(limit=o.limit, chunks_per_file=o.chunks_per_file, pool=o.pool, patterns=o.patterns)
    return None if o == plain else metadata_filter(o)


def hybrid_search(chunks: DataFrame, query: str, vector: list[float], options: SearchOptions | None = None, index: TextIndex | None = None) -> DataFrame:
    """The best chunks, one row each, with score and rank. Empty tables give no rows; a query without known
    words still gives the nearest vectors."""
    o = options or SearchOptions()
    keep = _kept(o)
    texts = top(bm25(chunks, query, keep, index=index), F.desc("score"), o.pool)
    near = top(vector_distances(chunks, vector, keep), F.asc("distance"), o.pool)
    return top(fuse(texts, near), F.desc("score"), o.limit)


def with_chunks(found: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Columns of the chunks put to found ids; found is at most a page of results."""
    return chunks.select("id", *columns).join(F.broadcast(found), "id").dropDuplicates(["id"])


def grouped_search(chunks: DataFrame, query: str, vector: list[float], options: SearchOptions | None = None, index: TextIndex | None = None) -> DataFrame:
    """Files by the sum of their chunks' scores, with the best chunks of each."""
    o = options or SearchOptions()
    keep = _kept(o)
    scored = fuse(top(bm25(chunks, query, keep, index=index), F.desc("score"), o.pool), top(vector_distances(chunks, vector, keep), F.asc("distance"), o.pool))
    rows = with_chunks(scored, chunks, "project_id", "file_path")
    by_file = Window.partitionBy("project_id", "file_path")
    rows = (rows.withColumn("chunk_rank", F.row_number().over(by_file.orderBy(F.desc("score"), "id")).cast("long")).withColumn("file_score", F.round(F.sum("score").over(by_file), 6)))
    files = rows.filter("chunk_rank = 1").orderBy(F.desc("file_score"), "project_id", "file_path").limit(o.limit).select("project_id", "file_path")
    return rows.filter(F.col("chunk_rank") <= o.chunks_per_file).join(F.broadcast(files), ["project_id", "file_path"]).select("project_id", "file_path", "file_score", "id", "chunk_rank", "score")


def relevance_percent(rows: DataFrame, score: str = "score") -> DataFrame:
    """Scores as a percentage of the greatest."""
    most = rows.agg(F.max(score).alias("_most"))
    return rows.crossJoin(F.broadcast(most)).withColumn("relevance", F.round(F.when(F.col("_most") > 0, F.col(score) / F.col("_most") * 100).otherwise(0.0), 6)).drop("_most")


def report(rows: DataFrame, title: str = "Results") -> str:
    """A Markdown page of a page of results (rank, file_path, start_line, end_line, relevance, content)."""
    out = [f"# {title}", ""]
    for r in rows.orderBy("rank").toLocalIterator():
        out += [f"## {r['rank']}. {r['file_path']}:{r['start_line']}-{r['end_line']} ({r['relevance']:.1f} %)", "", "```", r["content"], "```", ""]
    return "\n".join(out)
