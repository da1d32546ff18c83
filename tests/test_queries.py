"""Every named query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = {k: v for k, v in entry.queries().items() if not (k[0] == "p" and k[1].isdigit()) or k.startswith("p2_")}


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, data, db, tmp_path, name):
    out = str(tmp_path / name)
    CORE[name](spark, data).write.parquet(out)
    sql = entry.oracle_sql().get(name)
    if not sql:
        # what SQL can't say row by row is checked by the query of its invariants, which has SQL
        assert spark.read.parquet(out).count() > 0 and f"{name}_sound" in entry.oracle_sql()
        return
    db.execute(f"create or replace table a as {sql}")
    db.execute(f"create or replace table b as select * from '{out}/*.parquet'")
    kinds = [dict((r[0], r[1]) for r in db.execute(f"describe {t}").fetchall()) for t in "ab"]
    assert kinds[0] == kinds[1]
    cols = ", ".join(sorted(kinds[0]))
    for x, y in ("ab", "ba"):
        assert db.execute(f"select {cols} from {x} except all select {cols} from {y} limit 3").fetchall() == []


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
