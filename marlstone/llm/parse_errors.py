"""Source files that do not parse, by checkers of six languages.

Each file is read whole by the checker of its extension (see ``marlstone.llm.syntax``). One
pass over the scan, without a shuffle; the rates are an ordinary aggregation over its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.session import ship

#: Texts whose verdict a task remembers, so that stored versions without a change cost nothing.
REMEMBER = 50_000
ERROR = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("cause", T.StringType()), T.StructField("message", T.StringType())]))
SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("project_id", T.StringType()), T.StructField("language", T.StringType()), T.StructField("parses", T.BooleanType()),
    T.StructField("first_cause", T.StringType()), T.StructField("errors", ERROR)])


def parsed(files: DataFrame, id_col: str = "id", path_col: str = "file_path", text_col: str = "content", group_col: str = "project_id") -> DataFrame:
    """(id, project_id, language, parses, first_cause, errors) of every file in one of the six languages.

    The language is that of the extension, in any case. Files of other extensions and rows whose
    id, path or text is null aren't judged and have no row. Repeated rows are judged each.
    An empty text parses, but for Go, which needs its package clause. Other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        from marlstone.llm.syntax import LANGUAGES, problems

        known: dict[tuple[str, bytes], list] = {}
        for batch in batches:
            out: list[list] = [[] for _ in SCHEMA]
            for i, path, text, group in zip(*(batch.column(c).to_pylist() for c in range(4))):
                ext = path.rpartition(".")[2].lower() if path else ""
                if i is None or text is None or ext not in LANGUAGES:
                    continue
                key = (ext, xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                found = known.get(key)
                if found is None:
                    if len(known) > REMEMBER:
                        known.clear()
                    found = known[key] = [p._asdict() for p in problems(ext, text)]
                for col, v in zip(out, (i, group, LANGUAGES[ext], not found, found[0]["cause"] if found else None, found)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([
                *(pa.array(c, t) for c, t in zip(out[:5], (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()))),
                pa.array(out[5], pa.list_(pa.struct([("line", pa.int32()), ("cause", pa.string()), ("message", pa.string())])))], names=SCHEMA.names)

    ship(files.sparkSession)
    return files.select(*(F.col(c).cast("string") for c in (id_col, path_col, text_col, group_col))).mapInArrow(work, SCHEMA)


def error_rates(rows: DataFrame) -> DataFrame:
    """(project_id, language, files, failed, rate) of the output of ``parsed``; repeated ids count once."""
    one = rows.groupBy("id").agg(F.first("project_id").alias("project_id"), F.first("language").alias("language"), F.min("parses").alias("parses"))
    n, bad = F.count("*"), F.sum((~F.col("parses")).cast("long"))
    return one.groupBy("project_id", "language").agg(n.alias("files"), bad.alias("failed"), (bad / n).alias("rate"))
