"""A kept inverted index for BM25, in segments.

``postings`` holds (term, id, f, n) by segment and bucket of the term, sorted by term, so that a search reads the buckets of
its own terms and of these only the row groups that hold them. Rows are added as a new segment; those they replace, and rows taken
out, are written down in ``gone``, and each segment's sums in ``done``, whose presence makes the segment visible. Numbers of rows and
words are so known without reading postings; document frequencies are counts over the postings of the query's terms.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.session import exists, names, remove

BUCKETS = 64
#: Tasks that write one bucket, as a common term may be in a third of all rows.
SHARES = 4
SUMS = "docs long, words long, gone_docs long, gone_words long"


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def segments(self) -> list[int]:
        found = [n for n in names(self.spark, f"{self.root}/done") if n.startswith("seg=")]
        return sorted(int(n[4:]) for n in found if exists(self.spark, f"{self.root}/done/{n}/_SUCCESS"))

    def _read(self, part: str, schema: str) -> DataFrame:
        have = self.segments()
        if not have:
            return self.spark.createDataFrame([], schema + ", seg int")
        paths = [f"{self.root}/{part}/seg={s}" for s in have]
        return self.spark.read.schema(schema + ", seg int").option("basePath", f"{self.root}/{part}").parquet(*paths)

    def _gone(self) -> DataFrame:
        return self._read("gone", "id string, old int, n long").select("id", F.col("old").alias("seg"), "n")

    def docs(self) -> DataFrame:
        """(id, n, seg) of the rows that are in the index now."""
        return self._read("docs", "id string, n long").join(self._gone().select("id", "seg"), ["id", "seg"], "left_anti").select("id", "n", "seg")

    def totals(self) -> tuple[int, float]:
        """(number of rows, mean number of words)."""
        s = self._read("done", SUMS).agg(F.sum("docs") - F.sum("gone_docs"), F.sum("words") - F.sum("gone_words")).first()
        return (s[0] or 0, (s[1] or 0) / s[0] if s[0] else 0.0)

    def bucket(self, term: str) -> int:
        return zlib.crc32(term.encode("utf-8", "surrogatepass")) % self.buckets

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, id, f, n) of the rows that hold one of the terms."""
        found = self._read("postings", "term string, id string, f long, n long, bucket int")
        mine = found.filter(F.col("bucket").isin(sorted({self.bucket(t) for t in terms})) & F.col("term").isin(terms))
        return mine.join(self._gone().select("id", "seg"), ["id", "seg"], "left_anti").select("term", "id", "f", "n")

    def add(self, rows: DataFrame, id_col: str = "id", text_col: str = "content") -> int:
        """Index rows; an id that is in the index is replaced. Gives the number of the new segment.

        Repeated rows of an id count once (of different texts, the greater counts); null ids take no part, a null text has no words.
        """
        own = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), C.words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
        lengths = own.groupBy("id").agg(F.max(F.size("w")).cast("long").alias("n"))
        # repeated rows of an id are counted apart
        terms = (own.withColumn("row", F.monotonically_increasing_id()).select("id", "row", F.size("w").cast("long").alias("n"), F.explode("w").alias("term"))
                 .groupBy("id", "row", "term").agg(F.count("*").alias("f"), F.first("n").alias("n")).groupBy("id", "term").agg(F.max("f").alias("f"), F.max("n").alias("n")))
        return self._write(terms, lengths, lengths.select("id"))

    def remove(self, ids: DataFrame) -> int:
        """Take ids out of the index."""
        none = self.spark.createDataFrame([], "id string, n long, term string, f long")
        return self._write(none.select("id", "term", "f", "n"), none.select("id", "n"), ids.select(F.col(ids.columns[0]).cast("string").alias("id")).distinct())

    def _write(self, terms: DataFrame, docs: DataFrame, replaced: DataFrame) -> int:
        seg = max([0, *self.segments()]) + 1
        at = {k: f"{self.root}/{k}/seg={seg}" for k in ("postings", "docs", "gone", "done")}
        gone = self.docs().join(replaced, "id", "left_semi").select("id", F.col("seg").alias("old"), "n")
        gone.write.mode("overwrite").parquet(at["gone"])
        docs.select("id", "n").write.mode("overwrite").parquet(at["docs"])
        share = F.pmod(F.xxhash64("id"), F.lit(SHARES))
        (terms.withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(self.buckets)).cast("int")).repartition("bucket", share)
         .sortWithinPartitions("bucket", "term").select("term", "id", "f", "n", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at["postings"]))
        new = self.spark.read.schema("id string, n long").parquet(at["docs"]).agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
        old = self.spark.read.schema("id string, old int, n long").parquet(at["gone"]).agg(F.count("*").alias("gone_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("gone_words"))
        # both are single rows; with their mark the segment is visible
        new.crossJoin(old).write.mode("overwrite").parquet(at["done"])
        return seg

    def compact(self) -> int:
        """All live rows in one segment; older segments go."""
        have = self.segments()
        if not have:
            return 0
        gone = self._gone().select("id", "seg")
        found = self._read("postings", "term string, id string, f long, n long, bucket int").join(gone, ["id", "seg"], "left_anti").select("id", "term", "f", "n")
        docs = self.docs()
        seg = self._write(found, docs.select("id", "n"), docs.select("id"))
        for s in have:
            # first the mark, so that no reader meets half a segment
            for part in ("done", "postings", "docs", "gone"):
                remove(self.spark, f"{self.root}/{part}/seg={s}")
        # what the new segment replaced is no longer there to be subtracted
        docs = self.spark.read.schema("id string, n long").parquet(f"{self.root}/docs/seg={seg}")
        sums = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.lit(0).cast("long").alias("gone_docs"), F.lit(0).cast("long").alias("gone_words"))
        sums.write.mode("overwrite").parquet(f"{self.root}/done/seg={seg}")
        return seg
