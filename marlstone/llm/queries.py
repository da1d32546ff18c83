"""Queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.sources.tables import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.near_duplicates import near_duplicate_pairs

    return near_duplicate_pairs(load(spark, sf_dir, "code_chunks"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.near_duplicates import near_duplicate_classes

    return near_duplicate_classes(load(spark, sf_dir, "code_chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.handwritten import not_handwritten

    return not_handwritten(load(spark, sf_dir, "code_documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.neighbours import neighbour_pairs

    return neighbour_pairs(load(spark, sf_dir, "code_chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.code_languages import languages, running_text, train, word_counts

    model = train(word_counts(load(spark, sf_dir, "documents")))
    return running_text(languages(load(spark, sf_dir, "code_documents"), model))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.code_languages import languages, train, word_counts

    model = train(word_counts(load(spark, sf_dir, "documents")))
    return languages(load(spark, sf_dir, "code_documents"), model).dropDuplicates(["id", "nat_lang"])


def p5_chunk_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.code_languages import languages, train, word_counts

    model = train(word_counts(load(spark, sf_dir, "documents")))
    return languages(load(spark, sf_dir, "code_chunks"), model).dropDuplicates(["id", "nat_lang"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.parse_errors import parsed

    return parsed(load(spark, sf_dir, "code_documents")).filter("not parses").select("id").distinct()


def p6_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.parse_errors import parsed

    bad = parsed(load(spark, sf_dir, "code_documents")).filter("not parses").dropDuplicates(["id"])
    return bad.selectExpr("id", "language", "first_cause", "errors[0].line as first_line", "size(errors) as n_errors", "to_json(errors) as errors")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.parse_errors import error_rates, parsed

    return error_rates(parsed(load(spark, sf_dir, "code_documents")))


def p6_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rates must have in common with the table: files by project and language, and rates between 0 and 1."""
    from pyspark.sql import functions as F

    return p6_rates(spark, sf_dir).select("project_id", "language", "files", (F.col("rate").between(0, 1) & (F.col("failed") <= F.col("files"))).alias("sound"))


def p5_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose shares are no shares, and documents of p5_found without one: none."""
    from pyspark.sql import functions as F

    shares = p5_shares(spark, sf_dir).groupBy("id").agg(F.sum("share").alias("all"), F.min("share").alias("least"))
    wrong = shares.filter("all > 1.000001 or least <= 0").select("id")
    return wrong.unionByName(p5_found(spark, sf_dir).join(shares, "id", "left_anti").select("id")).agg(F.count("*").alias("wrong"))


def p9_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that overlap, are blank at an end or lie outside their text: none; and the texts that have sentences."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    w = Window.partitionBy("doc_id").orderBy("start_char")
    rows = p9_found(spark, sf_dir).withColumn("next", F.lead("start_char").over(w))
    wrong = ((F.col("next") < F.col("end_char")) | (F.col("start_char") >= F.col("end_char")) | (F.col("start_char") < 0)).cast("long")
    per = rows.groupBy("doc_id").agg(F.sum(wrong).alias("wrong"), F.max("end_char").alias("end"))
    both = per.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id")
    return both.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.col("wrong") + (F.col("end") > F.col("n")).cast("long")), F.lit(0)).alias("wrong"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.packing import pack_documents

    return pack_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "pack_limits"))


def p7_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.packing import packed, packing_facts, token_counts
    from marlstone.session import materialise

    counts = materialise(token_counts(load(spark, sf_dir, "documents"), "doc_id", "text"), "token-counts")
    limits = load(spark, sf_dir, "pack_limits")
    return packing_facts(materialise(packed(counts, limits), "packs"), counts, limits)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.leaks import leaked_items

    return leaked_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.llm.sentences import sentences

    return sentences(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


P1_SQL = r"""
WITH c AS (SELECT id, any_value(content) AS content FROM code_chunks GROUP BY id),
  w AS (SELECT id, regexp_extract_all(content, '[\p{L}\p{N}_]+') AS w FROM c),
  s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS s FROM w WHERE len(w) >= 20),
  u AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s),
  p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM p WHERE k::DOUBLE / (na + nb - k) >= 0.6
"""

P4_SQL = """
WITH v AS (SELECT id, any_value(embedding::DOUBLE[]) AS e FROM code_chunks WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY id),
  n AS (SELECT a.id AS x, b.id AS y, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.id) AS r FROM v a JOIN v b ON a.id <> b.id QUALIFY r <= 5)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM n
"""

# every document in every capacity, nothing cut without need, nothing above the capacity, nothing loose
P7_SQL = """
SELECT limit_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS torn, 0::BIGINT AS over, FALSE AS loose FROM pack_limits
"""

P6_SQL = r"""
SELECT project_id, CASE lower(regexp_extract(file_path, '\.(\w+)$', 1)) WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' END AS language,
  count(DISTINCT id) AS files, TRUE AS sound FROM code_documents WHERE content IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2 HAVING language IS NOT NULL
"""

# shares of a file lie between 0 and 1 and don't sum to more, and every file that holds text of a language by p5_found has its share
P5_SQL = "SELECT 0::BIGINT AS wrong"

P9_SQL = r"""
SELECT count(DISTINCT doc_id) AS texts, 0::BIGINT AS wrong FROM documents WHERE regexp_matches(text, '[\p{L}\p{N}]')
"""

P8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text <> ''),
  i AS (SELECT item_id, regexp_matches(lower(lang), '^(zh|ja)') AS east, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM eval_items),
  iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS g FROM i WHERE NOT east AND len(w) >= 13),
  dw AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS g FROM d WHERE len(w) >= 13),
  ic AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(s) - 28), lambda k: substr(s, k, 30))) AS g FROM (SELECT item_id, array_to_string(w, '') AS s FROM i WHERE east) WHERE length(s) >= 30),
  dc AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(s) - 28), lambda k: substr(s, k, 30))) AS g FROM (SELECT doc_id, array_to_string(w, '') AS s FROM d) WHERE length(s) >= 30)
SELECT DISTINCT doc_id, item_id FROM iw JOIN dw USING (g) UNION SELECT DISTINCT doc_id, item_id FROM ic JOIN dc USING (g)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p4_found": P4_SQL, "p6_sound": P6_SQL, "p7_sound": P7_SQL, "p8_found": P8_SQL, "p5_sound": P5_SQL, "p9_sound": P9_SQL}
