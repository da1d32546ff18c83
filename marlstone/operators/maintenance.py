"""Table maintenance as functions of DataFrames: change detection, upsert, replace, delete, path joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import columns as C

KEY = ["project_id", "file_path"]


def newest(rows: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """One row per key, the greatest by ``by``; found by aggregation, so a hot key combines before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    out = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return out.select(*key, "_r.*").select(*rows.columns)


def changed_only(listing: DataFrame, stored: DataFrame, key: list[str] | None = None, digest: str = "content_hash") -> DataFrame:
    """Listed rows that aren't stored with the same digest."""
    key = key or KEY
    old = stored.select(*key, F.col(digest).alias("_old")).dropDuplicates(key)
    return listing.join(old, key, "left").filter(F.col("_old").isNull() | ~F.col("_old").eqNullSafe(F.col(digest))).drop("_old")


def gone(stored: DataFrame, listing: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Stored keys that the listing no longer has."""
    key = key or KEY
    return stored.select(*key).distinct().join(listing.select(*key).distinct(), key, "left_anti")


def skipped(listing: DataFrame, stored: DataFrame, key: list[str] | None = None, digest: str = "content_hash", size: str = "file_size") -> DataFrame:
    """Files and bytes that needn't be read again, in one row."""
    key = key or KEY
    same = listing.join(stored.select(*key, F.col(digest).alias("_old")).distinct(), key, "left").withColumn("_same", F.coalesce(F.col("_old") == F.col(digest), F.lit(False)))
    return same.agg(F.sum(F.col("_same").cast("long")).alias("files"), F.coalesce(F.sum(F.when(F.col("_same"), F.col(size))), F.lit(0)).cast("long").alias("bytes"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; the last of repeated new keys isn't defined, so keys should be unique."""
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def replace_files(old: DataFrame, new: DataFrame, touched: DataFrame, key: list[str] | None = None) -> DataFrame:
    """All rows of the touched files are replaced by those of ``new``; a touched file without new rows is emptied."""
    key = key or KEY
    return old.join(touched.select(*key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def stale(old: DataFrame, new: DataFrame, key: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """Rows of touched files whose id the new set lacks."""
    key = key or KEY
    return old.join(new.select(*key).distinct(), key, "left_semi").join(new.select(id_col).distinct(), id_col, "left_anti").select(*old.columns)


def cascade_delete(deleted: DataFrame, *tables: DataFrame, key: list[str] | None = None) -> list[DataFrame]:
    """Each table without the rows of deleted files."""
    key = key or KEY
    d = deleted.select(*key).distinct()
    return [t.join(d, key, "left_anti").select(*t.columns) for t in tables]


def set_where(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """An UPDATE: the columns get new values in rows where the predicate holds."""
    hit = F.coalesce(where, F.lit(False))
    return rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def delete_where(rows: DataFrame, where: Column) -> DataFrame:
    return rows.filter(~F.coalesce(where, F.lit(False)))


def _folders(path: Column) -> Column:
    """The path itself and all folders above it."""
    parts = F.split(F.regexp_replace(path, "(?<=.)/+$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when((n == 1) & (F.element_at(parts, 1) == ""), F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))


def covering_folder(paths: DataFrame, folders: DataFrame, path: str = "path", folder: str = "directory") -> DataFrame:
    """Each path with the deepest folder that covers it; paths without one are left out.

    A path is unfolded to its own folders and joined by equality, so neither side is compared with all of the other.
    """
    own = paths.select(path).distinct().withColumn("_f", F.explode(_folders(F.col(path))))
    f = folders.withColumn("_f", F.regexp_replace(folder, "(?<=.)/+$", ""))
    hit = own.join(f, "_f")
    return hit.groupBy(path).agg(F.max_by(F.struct(*folders.columns), F.length("_f")).alias("_r")).select(path, "_r.*")


def expand_deletes(deleted: DataFrame, stored: DataFrame, path: str = "path") -> DataFrame:
    """(project_id, file_path): stored files at or below each deleted path; a path that covers none stands for itself."""
    own = stored.select(*KEY).distinct().withColumn("_f", F.explode(_folders(F.col("file_path"))))
    d = deleted.select("project_id", F.regexp_replace(path, "(?<=.)/+$", "").alias("_f")).distinct()
    return d.join(own, ["project_id", "_f"], "left").select("project_id", F.coalesce("file_path", "_f").alias("file_path")).distinct()


def in_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Files whose absolute path lies in their project's directory."""
    p = projects.select(F.col("id").alias("project_id"), "directory")
    return files.join(F.broadcast(p) if p.count() <= 10_000 else p, "project_id").filter(C.under_path("path", F.col("directory"))).drop("directory")


# Names of the changes and their order.
OPERATIONS = ("Add", "Update", "Delete")
CHANGES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("operation", T.StringType())]))


def task_changes(task_type: str = "task_type") -> Column:
    """The changes of a partial task from its JSON text; null for a full one."""
    return F.from_json(F.get_json_object(task_type, "$.PartialUpdate.changes"), CHANGES)


def is_full(task_type: str = "task_type") -> Column:
    return F.coalesce(F.trim(F.col(task_type), F.lit('"')) == "FullIndex", F.lit(False))


def merge_changes(tasks: DataFrame, by: list[str]) -> DataFrame:
    """The changes of many partial tasks as one set by group, in order of path and operation."""
    one = tasks.select(*by, F.explode(task_changes()).alias("c")).select(*by, "c.path", "c.operation").distinct()
    return one.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("path", "operation"))).alias("changes"))


def due_retries(batches: DataFrame, now: Column) -> DataFrame:
    return batches.filter(F.col("retry_after") <= now)


def due_rescans(projects: DataFrame, now: Column) -> DataFrame:
    """Active projects with an interval whose last run is at least that long ago, or that never ran. Intervals are microseconds."""
    due = F.col("last_indexed_at").isNull() | (F.unix_micros(F.col("last_indexed_at").cast("timestamp")) + F.col("rescan_interval") <= F.unix_micros(now.cast("timestamp")))
    return projects.filter((F.col("status") == "Active") & F.col("rescan_interval").isNotNull() & due)


def encoded_changes(changes: str) -> Column:
    """A list of changes (path, operation) as the JSON text of a partial task; the counterpart of ``task_changes``."""
    return F.to_json(F.struct(F.struct(F.col(changes).alias("changes")).alias("PartialUpdate")))


def run_counters(documents: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """One row: rows, distinct ids and bytes of documents and of chunks."""
    facts = lambda rows, name: rows.agg(F.count("*").alias(f"{name}_rows"), F.count_distinct(key).alias(name), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias(f"{name}_bytes"))
    # both sides are single rows
    return facts(documents, "documents").crossJoin(facts(chunks, "chunks"))


def event_kind(kind: str, detail: str) -> Column:
    """Operation that a file event stands for; null for events that change nothing."""
    k, d = F.lower(kind), F.lower(F.coalesce(F.col(detail), F.lit("")))
    return F.when((k == "create") & (d == "file"), "Update").when((k == "modify") & d.isin("content", "size", "data"), "Update").when(k == "remove", "Delete")


def ordinals(rows: DataFrame, by: list[str], order: list[str], name: str = "ordinal", prefix: str = "chunk_") -> DataFrame:
    """Place of a chunk in its file from 1, and the name that follows from it."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w).cast("long")).withColumn("default_name", F.concat(F.lit(prefix), F.col(name)))
