import sqlite3

import pytest

from corvine.operators import fulltext
from corvine.operators.query_grammar import QuerySyntaxError, parse

TEXTS = [
    "the quick brown fox jumps over the lazy dog",
    "quick quick fox",
    "a slow mongo-like database with élan and Elan",
    "completely unrelated words here for padding the corpus",
    "another quick note about databases and foxes",
    "snake_case token v1.2 C++ foo's naïve",
    "z y x w v u t",
    "alpha beta gamma delta epsilon zeta eta theta",
    "quick lazy fox. The fox was quick, and lazy! quick dog",
    "dog brown fox fox brown",
]
QUERIES = [
    "quick fox", "quick OR fox", "quick NOT fox", "fox*", '"brown fox"', "brown + fox", "mongo like", "élan", "NEAR(quick lazy, 1)",
    "NEAR(quick fox dog, 3)", "^quick", "quick AND (fox OR dog)", "snake_case", "quick OR fox AND dog", "quick NOT lazy OR dog",
    '"quick fo"*', 'NEAR("quick brown" lazy, 5)', "text_content:fox", "quick and fox", "mongo-like", "_", "zzz OR fox",
]
ERRORS = ["", '"', "AND", "quick AND", "*", "foo:bar", "v1.2", "foo's", "C++", "what?", "(quick OR fox) dog", "NOT fox", "a (b", "NEAR(a b, x)"]


@pytest.fixture(scope="module")
def indexed(spark):
    rows = [(i, t, "odd" if i % 2 else "even") for i, t in enumerate(TEXTS, 1)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text_content string, collection string").cache()
    return fulltext.Index.of(chunks), chunks


@pytest.fixture(scope="module")
def sqlite():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(text_content)")
    db.executemany("insert into f(rowid, text_content) values (?, ?)", enumerate(TEXTS, 1))
    return db


@pytest.mark.parametrize("query", QUERIES)
def test_as_the_full_text_engine_of_sqlite(indexed, sqlite, query):
    sql = "select rowid, -bm25(f), snippet(f, 0, '', '', '...', 5) from f where f match ? order by rank, rowid"
    want = sqlite.execute(sql, (query.replace("-", " "),)).fetchall()
    got = [(r.chunk_id, r.rank, r.snippet) for r in fulltext.search(*indexed, query, limit=-1).collect()]
    assert [(g[0], g[2]) for g in got] == [(w[0], w[2]) for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-12)


@pytest.mark.parametrize("query", ERRORS)
def test_errors(sqlite, query):
    with pytest.raises(sqlite3.OperationalError):
        sqlite.execute("select * from f where f match ?", (query,)).fetchall()
    with pytest.raises(QuerySyntaxError):
        parse(query)


def test_statistics_are_global_and_collection_filters(indexed):
    every = {r.chunk_id: r.rank for r in fulltext.search(*indexed, "quick", limit=-1).collect()}
    odd = {r.chunk_id: r.rank for r in fulltext.search(*indexed, "quick", collection="odd", limit=-1).collect()}
    assert odd == {k: v for k, v in every.items() if k % 2}
    assert fulltext.search(*indexed, "quick", collection="none").count() == 0
    assert fulltext.search(*indexed, "quick", limit=0).count() == 0


def test_saved_index_and_repeated_rows(spark, indexed, tmp_path):
    index, chunks = indexed
    fulltext.Index.of(chunks.union(chunks)).save(str(tmp_path / "i"))
    loaded = fulltext.Index.load(spark, str(tmp_path / "i"))
    want = [(r.chunk_id, r.rank) for r in fulltext.search(index, chunks, "quick OR brown", limit=-1).collect()]
    assert [(r.chunk_id, r.rank) for r in fulltext.search(loaded, chunks, "quick OR brown", limit=-1).collect()] == want


def test_empty_and_null_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "fox")], "chunk_id long, text_content string").selectExpr("*", "'c' as collection")
    assert [r.chunk_id for r in fulltext.search(fulltext.Index.of(rows), rows, "fox").collect()] == [3]
    assert fulltext.search(fulltext.Index.of(rows.limit(0)), rows.limit(0), "fox").count() == 0


def test_grouped_by_file(spark):
    hits = spark.createDataFrame([(1, 9.0, "a"), (2, 8.0, "b"), (3, 7.0, "a"), (4, 6.0, "c"), (5, 5.0, None)], "chunk_id long, rank double, file_path string")
    got = [(r.chunk_id, r.file_place, r.file_hits) for r in fulltext.grouped_by_file(hits, 2).orderBy("chunk_id").collect()]
    assert got == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]
