"""Queries of the general training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.operators import changed
from marlstone.sources.tables import load


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = changed.changed_files(load(spark, sf_dir, "file_scans"), load(spark, sf_dir, "code_documents"), load(spark, sf_dir, "index_tasks"),
                                     changed.state_folder(spark, sf_dir))
    return found


P2_SQL = """
WITH stored AS (
  SELECT d.project_id, d.file_path, d.content_hash, d.indexed_at FROM code_documents d
  WHERE EXISTS (SELECT 1 FROM index_tasks t WHERE t.project_id = d.project_id AND t.status IN ('completed', 'partially_completed')
                AND d.indexed_at BETWEEN t.started_at AND t.completed_at)),
newest AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY observed_at DESC NULLS LAST, scan_id DESC NULLS LAST) AS r FROM file_scans),
kept AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY indexed_at DESC, content_hash DESC NULLS LAST) AS r FROM stored)
SELECT n.project_id, n.file_path FROM newest n LEFT JOIN kept k ON n.project_id = k.project_id AND n.file_path = k.file_path AND k.r = 1
WHERE n.r = 1 AND n.operation IS DISTINCT FROM 'Delete' AND (k.project_id IS NULL OR n.content_hash IS DISTINCT FROM k.content_hash)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL}
