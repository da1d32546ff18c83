"""A versioned table of parquet files, cut into buckets.

A row lies in the bucket of its file (of its id in tables without files). Rows are written to
``data/v=N/bucket=B``, and version N of the table is a list of such folders, ``v=N``, at most buckets times appends long. A change reads
and writes only the buckets that it touches; the list of the new version names their new folders and the old ones
of all others. It becomes visible at once, when Spark puts the ``_SUCCESS`` mark on the list, so readers never meet half a
table and a failed write leaves nothing behind but folders that no list names. Old versions go by ``compact``.
Buckets can be partitioned further, so that a scan of one project reads its folders only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import maintenance as M
from marlstone.session import exists, names, remove
from marlstone.sources import schemas

BUCKETS = 32
#: (version and bucket of a folder, number of buckets of the table)
LIST = "v INT, bucket INT, of INT"


class Table:
    def __init__(self, spark: SparkSession, root: str, name: str, partition_by: list[str] | None = None, buckets: int = BUCKETS) -> None:
        if name not in schemas.DDL:
            raise ValueError(f"unknown table {name!r}")
        self.spark, self.name, self.root = spark, name, f"{root.rstrip('/')}/{name}"
        self.partition_by = partition_by or []
        self.by = M.KEY if "file_path" in schemas.DDL[name] else ["id"]
        listed = self._listed()
        self.buckets = listed[0][2] if listed else buckets

    def versions(self) -> list[int]:
        found = [n for n in names(self.spark, self.root) if n.startswith("v=") and n[2:].isdigit()]
        return sorted(int(n[2:]) for n in found if exists(self.spark, f"{self.root}/{n}/_SUCCESS"))

    def _listed(self, version: int | None = None) -> list[tuple[int, int, int]]:
        have = self.versions()
        if not have:
            return []
        return [tuple(r) for r in self.spark.read.schema(LIST).parquet(f"{self.root}/v={have[-1] if version is None else version}").collect()]

    def _rows(self, listed: list[tuple[int, int, int]]) -> DataFrame:
        """The rows of listed folders, with their bucket."""
        schema = schemas.empty(self.spark, self.name).schema
        if not listed:
            return self.spark.createDataFrame([], schema).withColumn("bucket", F.lit(0))
        paths = [f"{self.root}/data/v={v}/bucket={b}" for v, b, _ in listed]
        found = self.spark.read.schema(self.spark.createDataFrame([], schema).withColumns({"v": F.lit(0), "bucket": F.lit(0)}).schema)
        return found.option("basePath", f"{self.root}/data").parquet(*paths).select(*schema.names, "bucket")

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or an empty table with the right columns."""
        return self._rows(self._listed(version)).drop("bucket")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _commit(self, rows: DataFrame, kept: list[tuple[int, int, int]]) -> int:
        """Write ``rows`` into their buckets and list them beside the folders kept."""
        n = max([0, *self.versions()]) + 1
        folder = f"{self.root}/data/v={n}"
        rows = schemas.conform(rows, self.name).withColumn("bucket", self._bucket())
        rows.write.mode("overwrite").partitionBy("bucket", *self.partition_by).parquet(folder)
        new = [(n, int(x[7:]), self.buckets) for x in names(self.spark, folder) if x.startswith("bucket=")]
        self.spark.createDataFrame([*kept, *new], LIST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/v={n}")
        return n

    def _change(self, touched: DataFrame, change) -> int:
        """A new version in which the buckets of ``touched`` (a column bucket) hold what ``change`` makes of their rows."""
        some = {r[0] for r in touched.select("bucket").distinct().collect()}  # no more than there are buckets
        listed = self._listed()
        old = self._rows([x for x in listed if x[1] in some]).drop("bucket")
        return self._commit(change(old), [x for x in listed if x[1] not in some])

    def write(self, rows: DataFrame) -> int:
        """The whole table anew."""
        return self._commit(rows, [])

    def append(self, rows: DataFrame) -> int:
        return self._commit(rows, self._listed())

    def upsert(self, rows: DataFrame, key: list[str] | None = None) -> int:
        key = key or schemas.KEYS[self.name]
        new = schemas.conform(rows, self.name)
        touched = new.select(self._bucket().alias("bucket"))
        if not set(self.by) <= set(key):
            # a row may come from another bucket
            touched = touched.unionByName(self._rows(self._listed()).join(new.select(*key), key, "left_semi").select("bucket"))
        return self._change(touched, lambda old: M.upsert(old, new, key))

    def replace_files(self, rows: DataFrame, touched: DataFrame | None = None) -> int:
        new = schemas.conform(rows, self.name)
        files = (touched if touched is not None else new).select(*M.KEY)
        return self._change(files.unionByName(new.select(*M.KEY)).select(self._bucket().alias("bucket")), lambda old: M.replace_files(old, new, files))

    def delete_files(self, deleted: DataFrame) -> int:
        return self._change(deleted.select(self._bucket().alias("bucket")), lambda old: M.cascade_delete(deleted, old)[0])

    def update(self, where: Column, **values: Column) -> int:
        return self._change(self._rows(self._listed()).filter(where), lambda old: M.set_where(old, where, **values))

    def delete(self, where: Column) -> int:
        return self._change(self._rows(self._listed()).filter(where), lambda old: M.delete_where(old, where))

    def compact(self, keep: int = 2, files: int | None = None) -> list[int]:
        """Drop all but the newest versions, and the folders that only they name; with ``files`` the table is first rewritten by so many tasks."""
        if files and self.versions():
            self.write(self.read().repartition(files, *self.by))
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        named = {(v, b) for k in kept for v, b, _ in self._listed(k)}
        for v in old:
            remove(self.spark, f"{self.root}/v={v}")
        for n in names(self.spark, f"{self.root}/data"):
            v = int(n[2:])
            if kept and v <= kept[-1]:
                for b in names(self.spark, f"{self.root}/data/{n}"):
                    if b.startswith("bucket=") and (v, int(b[7:])) not in named:
                        remove(self.spark, f"{self.root}/data/{n}/{b}")
                if not any(x == v for x, _ in named):
                    remove(self.spark, f"{self.root}/data/{n}")
        return old

    def compact_every(self, n: int = 250, keep: int = 2) -> list[int]:
        return self.compact(keep) if len(self.versions()) > n else []
