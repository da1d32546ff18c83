"""Schemas of the persisted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DDL = {
    "documents": "id STRING, project_id STRING, file_path STRING, content STRING, content_hash BINARY, file_size BIGINT, last_modified TIMESTAMP_NTZ, indexed_at TIMESTAMP_NTZ, "
                 "languages ARRAY<STRING>, primary_language STRING, chunk_count INT",
    "chunks": "id STRING, file_id STRING, project_id STRING, file_path STRING, content STRING, chunk_hash BINARY, embedding ARRAY<FLOAT>, start_byte BIGINT, end_byte BIGINT, start_line BIGINT, "
              "end_line BIGINT, node_type STRING, node_name STRING, language STRING, parent_context STRING, scope_path ARRAY<STRING>, definitions ARRAY<STRING>, symbol_refs ARRAY<STRING>, indexed_at TIMESTAMP_NTZ",
    "projects": "id STRING, name STRING, directory STRING, description STRING, status STRING, deletion_requested_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, "
                "rescan_interval BIGINT, last_indexed_at TIMESTAMP_NTZ",
    "tasks": "id STRING, project_id STRING, path STRING, task_type STRING, status STRING, created_at TIMESTAMP_NTZ, started_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ, error STRING, "
             "files_indexed BIGINT, merged_into STRING",
    "failed_batches": "id STRING, task_id STRING, project_id STRING, project_path STRING, failed_files ARRAY<STRING>, errors STRING, retry_count INT, retry_after TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ",
}
#: Columns that only upserts by these keys may change.
KEYS = {"documents": ["project_id", "file_path"], "chunks": ["id"], "projects": ["id"], "tasks": ["id"], "failed_batches": ["id"]}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], DDL[table])


def conform(rows: DataFrame, table: str) -> DataFrame:
    """``rows`` with the table's columns, in order and type; null lists become empty, null items of lists go."""
    want = empty(rows.sparkSession, table).schema
    out = []
    for f in want.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.filter(F.coalesce(c, F.array().cast(f.dataType)), lambda x: x.isNotNull())
        out.append(c.alias(f.name))
    return rows.select(*out)
