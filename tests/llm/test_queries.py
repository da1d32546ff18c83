import pytest

from marlstone.llm import queries as Q

COLUMNS = {"p1_found": "id_a id_b", "p3_found": "id", "p4_found": "id_a id_b", "p5_found": "id nat_lang", "p6_found": "id", "p8_found": "doc_id item_id", "p9_found": "doc_id start_char end_char"}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, data, name):
    out = Q.queries()[name](spark, data)
    if name in COLUMNS:
        assert out.columns == COLUMNS[name].split()
    rows = out.collect()
    if name in COLUMNS:
        assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(q for q in Q.oracle_sql() if q.endswith("_sound")))
def test_invariants(spark, data, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "code_documents", "pack_limits"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    out = Q.queries()[name](spark, data)
    want = c.sql(Q.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, out.select(*c.sql(Q.oracle_sql()[name]).columns).collect()), key=str) == sorted(want, key=str)


def test_nothing_else_imports_this_subpackage():
    import pathlib

    root = pathlib.Path(Q.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "marlstone.llm" not in f.read_text()
