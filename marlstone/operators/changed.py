"""Processing only new or changed records.

Inputs are cut into partitions: the records of one group (a project), and of a large group a share by the
hash of its key. How many shares a group has follows from its rows and is kept in the state, so partitions
stay about ``rows`` large however uneven the groups are. Of each partition the state keeps a fingerprint:
row counts and sums of row hashes of the raw inputs, which add up in any order and combine before the
shuffle, with the version of the step that is computed. A run

1. writes the fingerprints of now beside those of the last finished run,
2. writes down which partitions differ: these are marked as in progress,
3. recomputes the marked partitions and replaces each of them whole by dynamic partition overwrite,
4. moves the new fingerprints into place.

A run that dies leaves its marks, and the next run recomputes marked partitions whatever
their fingerprints say, so a half-finished replacement never survives, even if the input has gone back to
what it was. Marks go when a later run has finished. Of two runs at once the second to finish fails, and its marks stay.
Which partitions changed is a table as well and never comes to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import exists, names, remove, rename, scratch_root

#: Rows of one partition, about.
ROWS = 200_000
STORED_STATUS = ("completed", "partially_completed")
Inputs = dict[str, DataFrame]


def row_hash(columns: list[str]) -> Column:
    """Hash of a row that tells nulls from values."""
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
    return F.xxhash64(nulls, *[F.col(c) for c in columns])


def fingerprints(parts: Inputs, by: str = "bucket", step: str = "1") -> DataFrame:
    """(by, source, step, n, lo, hi) of DataFrames that have the column ``by``.

    Repeated rows count, so a second copy of a row changes the fingerprint.
    """
    out = None
    for name, df in sorted(parts.items()):
        one = df.select(by, row_hash(sorted(c for c in df.columns if c != by)).alias("h")).groupBy(by).agg(
            F.count("*").alias("n"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"), F.sum(F.shiftrightunsigned("h", 32)).alias("hi"),
        ).select(by, F.lit(name).alias("source"), F.lit(step).alias("step"), "n", "lo", "hi")
        out = one if out is None else out.unionByName(one)
    return out


@dataclass
class ChangedParts:
    """State of one job under ``root``: ``result/bucket=…``, ``done/v=N`` (fingerprints and shares of finished
    runs) and ``running/…`` (runs that aren't finished). ``step`` names the version of what is computed."""

    spark: SparkSession
    root: str
    step: str = "1"
    rows: int = ROWS

    def version(self) -> int:
        """Number of the last finished run, 0 before the first."""
        return max([0, *(int(n[2:]) for n in names(self.spark, f"{self.root}/done") if n.startswith("v="))])

    def marks(self) -> list[tuple[int, str]]:
        """(version it started from, folder) of the runs that got as far as replacing partitions and didn't clean up."""
        found = [n for n in names(self.spark, f"{self.root}/running") if exists(self.spark, f"{self.root}/running/{n}/todo/_SUCCESS")]
        return [(int(n.split("-")[0]), f"{self.root}/running/{n}") for n in found]

    def _shares(self, inputs: Inputs, group: str, v: int) -> DataFrame:
        """(group, shares): kept from the last run unless a group has outgrown or shrunk below its number."""
        loads = None
        for df in inputs.values():
            one = df.groupBy(group).agg(F.count("*").alias("n"))
            loads = one if loads is None else loads.unionByName(one)
        loads = loads.groupBy(group).agg(F.sum("n").alias("n"))
        fresh = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n") / self.rows, F.lit(1.0))))).cast("int")
        if not v:
            return loads.select(group, fresh.alias("shares"))
        old = self.spark.read.parquet(f"{self.root}/done/v={v}/shares").withColumnRenamed("shares", "old")
        fits = (F.col("n") <= 2 * self.rows * F.col("old")) & ((F.col("old") == 1) | (8 * F.col("n") >= self.rows * F.col("old")))
        return loads.join(old, group, "left").select(group, F.when(fits, F.col("old")).otherwise(fresh).alias("shares"))

    def run(self, inputs: Inputs, group: str, key: str, compute: Callable[[Inputs], DataFrame], shared: Inputs | None = None) -> tuple[DataFrame, DataFrame]:
        """Bring the result up to date; gives the whole result and the partitions (bucket) that were recomputed.

        ``inputs`` have the columns ``group`` and ``key``, without nulls; ``shared`` ones only ``group``, and a change in
        them changes all partitions of the group. ``compute`` gets the inputs of the changed partitions, with
        the column ``bucket``, and keeps it.
        """
        spark, v = self.spark, self.version()
        marks = self.marks()
        own = f"{self.root}/running/{v}-{uuid.uuid4().hex}"
        self._shares(inputs, group, v).write.parquet(f"{own}/shares")
        shares = spark.read.schema(inputs[next(iter(inputs))].select(group, F.lit(0).alias("shares")).schema).parquet(f"{own}/shares")
        bucket = F.concat_ws("-", F.lower(F.hex(F.xxhash64(group))), "shares", F.pmod(F.xxhash64(F.col(key)), F.col("shares")))
        parts = {k: d.join(shares, group).withColumn("bucket", bucket).drop("shares") for k, d in inputs.items()}
        prints = fingerprints(parts, "bucket", self.step)
        if shared:
            whole = shares.select(group, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("i"), "shares")
            every = whole.select(group, F.concat_ws("-", F.lower(F.hex(F.xxhash64(group))), "shares", "i").alias("bucket"))
            prints = prints.unionByName(fingerprints(shared, group, self.step).join(every, group).drop(group))
        prints.write.parquet(f"{own}/prints")
        now = spark.read.parquet(f"{own}/prints")
        todo = now.select("bucket")
        if v:
            old = spark.read.schema(now.schema).parquet(f"{self.root}/done/v={v}/prints")
            todo = now.exceptAll(old).select("bucket").unionByName(old.exceptAll(now).select("bucket"))
        for _, folder in marks:
            todo = todo.unionByName(spark.read.schema("bucket string").parquet(f"{folder}/todo"))
        todo.distinct().write.parquet(f"{own}/todo")
        todo = spark.read.schema("bucket string").parquet(f"{own}/todo")
        rows = compute({k: d.join(todo, "bucket", "left_semi") for k, d in parts.items()}).withColumn("_row", F.lit(True))
        schema = rows.schema
        if todo.head(1):
            # a partition without rows must be replaced as well: each gets a row that only marks it
            (rows.unionByName(todo.withColumn("_row", F.lit(False)), allowMissingColumns=True).repartition("bucket").write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/result"))
            self._finish(own, v)
            for since, folder in marks:
                # those of this version may still be at work, so they go one run later
                if since < v:
                    remove(spark, folder)
            todo = spark.read.schema("bucket string").parquet(f"{self.root}/done/v={v + 1}/todo")
        else:
            todo = spark.createDataFrame([], "bucket string")
            remove(spark, own)
        if not exists(spark, f"{self.root}/result"):
            return spark.createDataFrame([], schema).drop("_row"), todo
        return spark.read.schema(schema).parquet(f"{self.root}/result").filter("_row").drop("_row"), todo

    def _finish(self, own: str, v: int) -> None:
        if not rename(self.spark, own, f"{self.root}/done/v={v + 1}"):
            raise RuntimeError(f"another run has finished version {v + 1}; the partitions of this one are done again by the next run")


def stored_documents(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows that a successful run (project_id, started_at, completed_at) of their project wrote.

    Runs are unfolded to the days they touch, so a row meets only the runs of its own day and
    the join is spread by project and day, not by project alone.
    """
    days = runs.select(F.col("project_id").alias("t_project"), "started_at", "completed_at",
                       F.explode(F.sequence(F.to_date("started_at"), F.to_date("completed_at"))).alias("t_day"))
    d = documents.withColumn("_day", F.to_date("indexed_at"))
    on = (F.col("project_id") == F.col("t_project")) & (F.col("_day") == F.col("t_day")) & F.col("indexed_at").between(F.col("started_at"), F.col("completed_at"))
    return d.join(days, on, "left_semi").drop("_day")


def unstored_files(parts: Inputs, runs: DataFrame) -> DataFrame:
    """(bucket, project_id, file_path): files whose newest observation no stored row matches."""
    key = ["bucket", "project_id", "file_path"]
    seen = parts["scans"].groupBy(*key).agg(F.max_by(F.struct("operation", "content_hash"), F.struct("observed_at", "scan_id")).alias("o"))
    kept = stored_documents(parts["documents"], runs).groupBy(*key).agg(F.max(F.struct("indexed_at", "content_hash")).alias("s"))
    both = seen.filter("o.operation is null or o.operation != 'Delete'").join(kept, key, "left")
    return both.filter(F.col("s").isNull() | ~F.col("o.content_hash").eqNullSafe(F.col("s.content_hash"))).select(*key)


def changed_files(scans: DataFrame, documents: DataFrame, tasks: DataFrame, state: str, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(project_id, file_path) still to be processed, and the partitions (bucket) this run recomputed.

    ``state`` is a folder that outlives the session and that all executors share. Rows without project or path take no
    part. The newest observation is the greatest ``observed_at``, then ``scan_id``; a null time is older than any other;
    ``last_modified`` says nothing certain and isn't asked. Of equal newest stored rows the greatest hash counts.
    Repeated rows change nothing but the fingerprint. Empty tables give no rows; columns beyond those named are ignored.
    """
    keyed = "project_id is not null and file_path is not null"
    runs = (tasks.filter(F.col("status").isin(*STORED_STATUS)).filter("project_id is not null and started_at <= completed_at")
            .select("project_id", "started_at", "completed_at"))
    inputs = {"scans": scans.filter(keyed).select("project_id", "file_path", "operation", "content_hash", "observed_at", "scan_id"),
              "documents": documents.filter(keyed).select("project_id", "file_path", "content_hash", "indexed_at")}
    job = ChangedParts(scans.sparkSession, state, step="unstored-files 1", rows=rows)
    found, redone = job.run(inputs, "project_id", "file_path", lambda parts: unstored_files(parts, runs), {"runs": runs})
    return found.select("project_id", "file_path"), redone


def state_folder(spark: SparkSession, name: str) -> str:
    """The folder of a named job below ``spark.marlstone.state``, or where that is unset below the shared folder."""
    root = spark.conf.get("spark.marlstone.state", None) or f"{scratch_root(spark)}/marlstone-state"
    return f"{root.rstrip('/')}/changed-{uuid.uuid5(uuid.NAMESPACE_URL, name).hex}"
