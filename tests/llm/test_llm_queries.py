"""The training-data queries on the smallest tables: against SQL where there is some, else schema and a repeatable result."""

import os
from pathlib import Path

import pytest

from corvine.llm import oracle, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = queries.queries(), oracle.oracle_sql()
COLUMNS = {
    "p1_found": ["chunk_id"], "p2_found": ["chunk_id"], "p3_found": ["chunk_id_a", "chunk_id_b"], "p4_found": ["chunk_id", "line_no"], "p5_found": ["file_id"],
    "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables aren't here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name.startswith("p8"):
        pytest.importorskip("public_tokenizers")
    got = QUERIES[name](spark, SF)
    rows = sorted(map(str, got.collect()))
    assert got.columns == COLUMNS.get(name, got.columns)
    if name in COLUMNS:
        assert len(rows) == len(set(rows)) and rows
    if name in SQL:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            con.sql(f"create view {p.stem} as select * from '{p}'")
        want = con.sql(SQL[name])
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[want.columns.index(c)] for c in got.columns) for r in want.fetchall())
