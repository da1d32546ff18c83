"""Lists as table, TSV or JSON, with a choice of columns."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _page(rows: DataFrame, columns: list[str] | None, most: int) -> tuple[list[str], list]:
    """A page for the driver. What has more rows is never cut: it is an error, and ``write_tsv`` is for whole tables."""
    picked = rows.select(*columns) if columns else rows
    page = picked.limit(most + 1).collect()
    if len(page) > most:
        raise ValueError(f"more than {most} rows: raise most, choose rows or use write_tsv")
    return picked.columns, page


def as_table(rows: DataFrame, columns: list[str] | None = None, header: bool = True, most: int = 1000) -> str:
    names, page = _page(rows, columns, most)
    cells = ([names] if header else []) + [["" if v is None else str(v) for v in r] for r in page]
    widths = [max((len(r[i]) for r in cells), default=0) for i in range(len(names))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in cells)


def as_tsv(rows: DataFrame, columns: list[str] | None = None, header: bool = True, most: int = 1000) -> str:
    names, page = _page(rows, columns, most)
    clean = lambda v: "" if v is None else str(v).replace("\t", " ").replace("\n", " ")
    return "\n".join(["\t".join(names)] * header + ["\t".join(map(clean, r)) for r in page])


def as_json(rows: DataFrame, columns: list[str] | None = None, most: int = 1000) -> str:
    names, page = _page(rows, columns, most)
    return json.dumps([dict(zip(names, r)) for r in page], indent=2, default=str, ensure_ascii=False)


def write_tsv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """The whole table, written by the executors."""
    (rows.select(*columns) if columns else rows).write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def tsv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): one TSV line a row, as a column."""
    return rows.select(F.concat_ws("\t", *[F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\n", "  ") for c in columns]).alias("line"))
