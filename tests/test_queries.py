"""Every core query against its SQL form on the smallest tables."""

import os
from pathlib import Path

import pytest

from corvine.plans import oracle, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), oracle.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(rows):
    def one(v):
        if v is None or v != v:
            return "null"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = plain(tuple(r[c] for c in columns) for r in got.collect())
    if name not in SQL:
        assert len(set(got.columns)) == len(got.columns)
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert rows == plain(tuple(r[i] for i in order) for r in want.fetchall())


def test_every_sql_form_has_its_query():
    assert set(SQL) <= set(QUERIES)
