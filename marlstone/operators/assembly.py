"""Chunks back to files: completeness, language weights, batches, failures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.session import materialise, shuffle_partitions, ship

BATCH = 256


def completeness(chunks: DataFrame, ends: DataFrame, key: list[str]) -> DataFrame:
    """(key, received, expected, complete): a file is complete when it got as many chunks as its end mark says."""
    got = chunks.groupBy(*key).agg(F.count("*").alias("received"))
    want = ends.groupBy(*key).agg(F.max("expected_chunks").cast("long").alias("expected"))
    both = want.join(got, key, "full_outer")
    return both.select(*key, F.coalesce("received", F.lit(0)).cast("long").alias("received"), "expected", F.coalesce(F.coalesce("received", F.lit(0)) == F.col("expected"), F.lit(False)).alias("complete"))


def language_weights(chunks: DataFrame, key: list[str], text: str = "content", language: str = "language", tokens: str | None = None) -> DataFrame:
    """(key, language, weight): tokens where counted, else a quarter of the bytes."""
    w = F.coalesce(F.size(F.when(F.col(tokens).isNotNull(), F.col(tokens))), C.token_estimate(text)) if tokens else C.token_estimate(text)
    return chunks.groupBy(*key, F.col(language).alias("language")).agg(F.sum(w).cast("long").alias("weight"))


def file_languages(weights: DataFrame, key: list[str]) -> DataFrame:
    """(key, languages, primary_language): by weight, ties by name."""
    out = weights.filter("language is not null").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("language").alias("l")))).alias("s"))
    return out.select(*key, F.transform("s", lambda x: x["l"]).alias("languages"), F.element_at("s", 1)["l"].alias("primary_language"))


def build_documents(chunks: DataFrame, ends: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Document rows of complete files from their chunks and end marks (key, content, expected_chunks)."""
    key = key or ["project_id", "file_path"]
    done = completeness(chunks, ends, key).filter("complete").select(*key, F.col("received").cast("int").alias("chunk_count"))
    langs = file_languages(language_weights(chunks, key), key)
    return (ends.dropDuplicates(key).join(done, key).join(langs, key, "left")
            .select(C.stable_id(*key).alias("id"), *key, "content", C.content_digest("content").alias("content_hash"), F.octet_length("content").cast("long").alias("file_size"),
                    F.coalesce("languages", F.array().cast("array<string>")).alias("languages"), "primary_language", "chunk_count"))


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Place of every row in its group from 1, whatever the size of the group.

    Rows are ranged by group and order over many partitions and written once with the partition's number; a place is
    the number of rows in the group's earlier partitions plus the place in its own. No task sorts a whole hot group.
    """
    n = shuffle_partitions(rows.sparkSession)
    placed = materialise(rows.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_c")).drop("_c")
    own = placed.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    return own.join(before, [*by, "_part"]).withColumn(name, F.col("_before") + F.col("_r")).select(*rows.columns, name)


def fixed_batches(rows: DataFrame, by: list[str], order: list[str], size: int = BATCH) -> DataFrame:
    """A batch number for every row: ``size`` rows a batch within each group."""
    return ranked(rows, by, order, "_rank").withColumn("batch_id", F.floor((F.col("_rank") - 1) / size).cast("long")).drop("_rank")


def token_batches(rows: DataFrame, by: list[str], order: list[str], tokens: str, most_items: int = 128, most_tokens: int = 96_000) -> DataFrame:
    """Batches filled in order until an item or token limit; an item above the limit travels alone.

    The scan is sequential within a group, so groups are the upstream batches; it runs over sorted partitions and
    keeps two numbers a group, never a group.
    """
    from pyspark.sql import types as T

    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("batch_id", T.LongType())])
    src = rows.repartition(*by).sortWithinPartitions(*by, *order)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, batch, items, total = None, 0, 0, 0
        for part in parts:
            keys = list(part[by].itertuples(index=False, name=None))
            out = []
            for k, t in zip(keys, part[tokens].fillna(0).tolist()):
                if k != group:
                    group, batch, items, total = k, 0, 0, 0
                elif items >= most_items or items and total + t > most_tokens:
                    batch, items, total = batch + 1, 0, 0
                items += 1
                total += t
                out.append(batch)
            yield part[names].assign(batch_id=out)

    ship(src.sparkSession)
    return src.mapInPandas(work, schema)


def without_failed(rows: DataFrame, failed: DataFrame, key: list[str]) -> DataFrame:
    """Rows of files that didn't fail; late rows of a failed file go with it."""
    return rows.join(failed.select(*key).distinct(), key, "left_anti")


def failed_summary(batches: DataFrame, by: list[str]) -> DataFrame:
    """(by, files, message): the union of failed files by group."""
    one = batches.select(*by, F.explode("failed_files").alias("f")).distinct()
    return one.groupBy(*by).agg(F.sort_array(F.collect_list("f")).alias("files"), F.count("*").alias("n")).withColumn("message", F.concat(F.col("n"), F.lit(" files failed"))).drop("n")


def corpus_size(rows: DataFrame, size: str) -> DataFrame:
    return rows.agg(F.count(size).alias("files"), F.sum(size).alias("total"), F.max(size).alias("largest"), F.min(size).alias("smallest"))


def chunk_summary(chunks: DataFrame, key: list[str]) -> DataFrame:
    """Files, chunks and chunks a file, in one row."""
    per = chunks.groupBy(*key).agg(F.count("*").alias("c"))
    return per.agg(F.count("*").alias("files"), F.sum("c").alias("chunks"), F.round(F.avg("c"), 6).alias("mean_chunks"), F.max("c").alias("most_chunks"))
