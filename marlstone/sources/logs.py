"""Timing logs as CSV: raw measurements one file a language, summaries, processing logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.operators import performance as P

RAW = "timestamp_ms BIGINT, file_size BIGINT, bucket STRING, duration_ms DOUBLE, operation STRING"
LOG = "timestamp_ms BIGINT, file_path STRING, language STRING, file_size BIGINT, duration_ms DOUBLE, operation STRING"


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements with the language from the file's name; lines that don't fit the columns are dropped."""
    rows = spark.read.schema(RAW).option("header", True).option("mode", "DROPMALFORMED").csv(f"{folder}/*.csv")
    return rows.withColumn("language", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.csv)(?:/|$)", 1)).withColumn("ts", C.epoch_ms("timestamp_ms"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).option("header", True).option("mode", "DROPMALFORMED").csv(path).withColumn("ts", C.epoch_ms("timestamp_ms"))


def write_raw(rows: DataFrame, folder: str) -> None:
    """One folder a language, named so that ``read_raw`` finds the language again."""
    rows.withColumn("f", F.concat(C.safe_name("language"), F.lit(".csv"))).select("f", "timestamp_ms", "file_size", C.size_bucket("file_size").alias("bucket"), "duration_ms", "operation") \
        .write.mode("append").partitionBy("f").option("header", True).csv(folder)


def write_summary(rows: DataFrame, folder: str) -> None:
    P.online_stats(rows).write.mode("overwrite").option("header", True).csv(folder)
