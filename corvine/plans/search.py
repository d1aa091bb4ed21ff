"""Full-text, vector and hybrid queries over the chunks and the test vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import text as T
from corvine.functions.vectors import norm, normalized
from corvine.operators import fulltext, fusion, vectors
from corvine.plans import model
from corvine.session import scratch_path, table

POOL = 25  # five times the default limit of 5
COLLECTION = "platform-handbook"

# name: (query, its SQL condition and phrases as (SQL test of a token array w, name))
TEXT_QUERIES = {
    "fts_bm25_and": "shared snapshot",
    "fts_bm25_or": "quarry OR zephyr",
    "fts_bm25_not": "snapshot NOT shared",
    "fts_prefix": "snap*",
    "fts_phrase": '"storage team"',
    "fts_first_token": "^operators",
    "fts_near": "NEAR(storage records, 4)",
    "fts_boolean": "quarry AND (zephyr OR snapshot) OR lantern NOT shared",
}


_kept: dict[tuple, str] = {}


def _index(spark: SparkSession, sf: str) -> fulltext.Index:
    """The kept index of the chunks, in the shared folder: built by the first query of an application that asks, and anew
    when the table isn't the same any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/chunks.parquet")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    state = (spark.sparkContext.applicationId, sf, fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime())
    if state not in _kept:
        path = scratch_path(spark, "index", keep=False)
        fulltext.Index.of(table(spark, sf, "chunks"), "id").save(path)
        _kept[state] = path
    return fulltext.Index.load(spark, _kept[state])


def _search(spark: SparkSession, sf: str, query: str, collection: str | None = None, limit: int = POOL) -> DataFrame:
    return fulltext.search(_index(spark, sf), model.chunk_rows(spark, sf), query, collection, limit, with_snippet=False)


def _ranked(name: str, query: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _search(spark, sf, query).select("chunk_id", F.round("rank", 6).alias("rank"))

    run.__name__ = name
    return run


def fts_bm25_collection(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "shared snapshot", COLLECTION).select("chunk_id", F.round("rank", 6).alias("rank"))


def fts_snippets(spark: SparkSession, sf: str) -> DataFrame:
    chunks = model.chunk_rows(spark, sf, "text_content")
    return fulltext.search(_index(spark, sf), chunks, "shared snapshot", limit=POOL).select("chunk_id", "snippet", F.round("rank", 6).alias("rank"))


def fts_grouped_by_file(spark: SparkSession, sf: str) -> DataFrame:
    from corvine.operators.catalog import ENRICHING, enriched

    hits = enriched(_search(spark, sf, "shared snapshot").select("chunk_id", "rank"), model.chunks(spark, sf, *ENRICHING), model.documents(spark, sf), model.files(spark, sf))
    return fulltext.grouped_by_file(hits, 5).select("chunk_id", "file_path", "file_place", "file_hits")


def postings_df_topn(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).document_frequencies().orderBy(F.desc("n_rows"), "term").limit(50)


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).statistics().select("n_rows", F.round("avg_tokens", 6).alias("avg_tokens"))


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return model.vectors(spark, sf).where("chunk_id = 0").first()["embedding"]


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.top_k(model.vectors(spark, sf), _query_vector(spark, sf), 10).select("chunk_id", F.round("score", 6).alias("score"))


def vector_topk_collection(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.top_k(model.vectors(spark, sf), _query_vector(spark, sf), 10, "label-3").select("chunk_id", F.round("score", 6).alias("score"))


def vector_batch_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = model.vectors(spark, sf)
    asked = rows.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return vectors.batch_top_k(rows, asked, 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "place")


def vector_l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = model.vectors(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(3.0).cast("float")))
    return rows.select("chunk_id", F.round(norm(F.col("embedding")), 4).alias("norm"), F.round(norm(normalized(F.col("embedding"))), 4).alias("unit"))


def vector_dim_count(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.dimensions(model.vectors(spark, sf))


def vector_hits_with_chunks(spark: SparkSession, sf: str) -> DataFrame:
    hits = vectors.top_k(model.vectors(spark, sf), _query_vector(spark, sf), POOL)
    shown = vectors.with_chunks(hits, model.chunk_rows(spark, sf, "document_id", "text_content"))
    return shown.select("chunk_id", "document_id", F.round("score", 6).alias("score"), T.snippet(F.col("text_content")).alias("snippet"))


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    text = _search(spark, sf, "quarry OR zephyr OR snapshot").select("chunk_id", "rank")
    near = vectors.top_k(model.vectors(spark, sf), _query_vector(spark, sf), POOL).select("chunk_id", F.col("score").alias("rank"))
    return fusion.fused(text, near, 20).select("chunk_id", F.round("score", 8).alias("score"), "in_text", "in_vector")


def sigmoid_boost(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"))
    return rows.select("l_orderkey", "l_linenumber", F.round(T.sigmoid(F.col("x"), 20.0, 5.0, 0.5), 8).alias("boost"))


QUERIES = {name: _ranked(name, q) for name, q in TEXT_QUERIES.items()}
QUERIES |= {f.__name__: f for f in (fts_bm25_collection, fts_snippets, fts_grouped_by_file, postings_df_topn, corpus_stats, vector_topk, vector_topk_collection, vector_batch_topk, vector_l2_normalize, vector_dim_count, vector_hits_with_chunks, hybrid_rrf, sigmoid_boost)}

_TOKENS = rf"{model.SQL}, t AS (SELECT chunk_id, collection, regexp_extract_all(strip_accents(lower(coalesce(text_content, ''))), '[\p{{L}}\p{{N}}]+') AS w FROM m_chunks), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t)"


def _count(test: str) -> str:
    """SQL: how many places i of the tokens w pass a test."""
    return f"len(list_filter(range(1, len(w) + 1), lambda i: {test}))"


_FORMS = {
    "fts_bm25_and": ("f0 > 0 AND f1 > 0", ["w[i] = 'shared'", "w[i] = 'snapshot'"]),
    "fts_bm25_or": ("f0 > 0 OR f1 > 0", ["w[i] = 'quarry'", "w[i] = 'zephyr'"]),
    "fts_bm25_not": ("f0 > 0 AND f1 = 0", ["w[i] = 'snapshot'", "w[i] = 'shared'"]),
    "fts_prefix": ("f0 > 0", ["starts_with(w[i], 'snap')"]),
    "fts_phrase": ("f0 > 0", ["w[i] = 'storage' AND i < len(w) AND w[i + 1] = 'team'"]),
    "fts_first_token": ("f0 > 0", ["i = 1 AND w[i] = 'operators'"]),
    "fts_boolean": ("(f0 > 0 AND (f1 > 0 OR f2 > 0)) OR (f3 > 0 AND f4 = 0)", ["w[i] = 'quarry'", "w[i] = 'zephyr'", "w[i] = 'snapshot'", "w[i] = 'lantern'", "w[i] = 'shared'"]),
}


def _ranked_ctes(condition: str, tests: list[str], filters: list[str] | None = None, collection: str = "") -> str:
    """CTEs down to ``ranked`` (chunk_id, rank); a phrase only counts where its filter holds."""
    filters = filters or [f"f{i} > 0" for i in range(len(tests))]
    counts = ", ".join(f"{_count(t)} AS f{i}" for i, t in enumerate(tests))
    sums = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(tests)))
    terms = []
    for i, keep in enumerate(filters):
        idf = f"ln((n - d{i} + 0.5) / (d{i} + 0.5))"
        idf = f"CASE WHEN {idf} > 0 THEN {idf} ELSE 1e-6 END"
        terms.append(f"CASE WHEN {keep} THEN {idf} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / a)) ELSE 0 END")
    where = f"({condition})" + (f" AND collection = '{collection}'" if collection else "")
    return f"{_TOKENS}, f AS (SELECT chunk_id, collection, len(w) AS l, {counts} FROM t), d AS (SELECT {sums} FROM f), ranked AS (SELECT chunk_id, {' + '.join(terms)} AS rank FROM f, d, s WHERE {where})"


def _top(ctes: str) -> str:
    return f"WITH {ctes} SELECT chunk_id, round(rank, 6) AS rank FROM ranked ORDER BY ranked.rank DESC, chunk_id LIMIT {POOL}"


_NEAR = "list_has_any(list_transform(range(-5, 6), lambda d: CASE WHEN d <> 0 AND i + d BETWEEN 1 AND len(w) THEN w[i + d] ELSE NULL END), ['{}'])"
_AND = _ranked_ctes(*_FORMS["fts_bm25_and"])
_DOT = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_VECTORS = f"{model.SQL}, q AS (SELECT embedding FROM m_vectors WHERE chunk_id = 0), scored AS (SELECT v.chunk_id, v.collection, {_DOT} AS score FROM m_vectors v, q)"
_SIGMOID = "1 / (1 + exp(-(CASE WHEN {x} < {c} THEN {l} ELSE {r} END) * ({x} - {c})))"

SQL = {name: _top(_ranked_ctes(*form)) for name, form in _FORMS.items() if name != "fts_boolean"}
SQL |= {
    "fts_boolean": _top(_ranked_ctes(*_FORMS["fts_boolean"], filters=["f0 > 0 AND (f1 > 0 OR f2 > 0)", "f0 > 0 AND (f1 > 0 OR f2 > 0)", "f0 > 0 AND (f1 > 0 OR f2 > 0)", "f3 > 0 AND f4 = 0", "f3 > 0 AND f4 = 0"])),
    "fts_near": "WITH " + _ranked_ctes("g0 > 0 AND g1 > 0", ["w[i] = 'storage'", "w[i] = 'records'"]).replace(
        " FROM t), d AS", ", " + ", ".join(f"{_count(f'''w[i] = '{a}' AND {_NEAR.format(b)}''')} AS g{i}" for i, (a, b) in enumerate((("storage", "records"), ("records", "storage")))) + " FROM t), d AS"
    ).replace("* f0 * 2.2 / (f0", "* g0 * 2.2 / (g0").replace("* f1 * 2.2 / (f1", "* g1 * 2.2 / (g1") + f" SELECT chunk_id, round(rank, 6) AS rank FROM ranked ORDER BY ranked.rank DESC, chunk_id LIMIT {POOL}",
    "fts_bm25_collection": _top(_ranked_ctes(*_FORMS["fts_bm25_and"], collection=COLLECTION)),
    "fts_grouped_by_file": f"""
        WITH {_AND},
        pool AS (SELECT chunk_id, rank FROM ranked ORDER BY rank DESC, chunk_id LIMIT {POOL}),
        hit AS (SELECT pool.chunk_id, f.file_path, row_number() OVER (ORDER BY rank DESC, pool.chunk_id) AS place
                FROM pool JOIN m_chunks c USING (chunk_id) JOIN m_documents d USING (document_id) JOIN m_files f USING (file_id)),
        first AS (SELECT *, min(place) OVER (PARTITION BY file_path) AS p, count(*) OVER (PARTITION BY file_path) AS file_hits FROM hit)
        SELECT chunk_id, file_path, file_place, file_hits FROM (SELECT *, dense_rank() OVER (ORDER BY p) AS file_place FROM first) WHERE file_place <= 5""",
    "postings_df_topn": f"WITH {_TOKENS}, p AS (SELECT chunk_id, unnest(w) AS term FROM t) SELECT term, count(DISTINCT chunk_id) AS n_rows, count(*) AS n_total FROM p GROUP BY term ORDER BY n_rows DESC, term LIMIT 50",
    "corpus_stats": f"WITH {_TOKENS} SELECT n AS n_rows, round(a, 6) AS avg_tokens FROM s",
    "vector_topk": f"WITH {_VECTORS} SELECT chunk_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, chunk_id LIMIT 10",
    "vector_topk_collection": f"WITH {_VECTORS} SELECT chunk_id, round(score, 6) AS score FROM scored WHERE collection = 'label-3' ORDER BY scored.score DESC, chunk_id LIMIT 10",
    "vector_batch_topk": f"""
        WITH {model.SQL}, scored AS (SELECT q.chunk_id AS query_id, v.chunk_id, {_DOT} AS score FROM m_vectors q, m_vectors v WHERE q.chunk_id % 100 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM scored)
        SELECT query_id, chunk_id, round(score, 6) AS score, place FROM ranked WHERE place <= 5""",
    "vector_l2_normalize": f"WITH {model.SQL}, n AS (SELECT chunk_id, sqrt(list_sum(list_transform(embedding, lambda x: 9 * x::DOUBLE * x::DOUBLE))) AS norm FROM m_vectors) SELECT chunk_id, round(norm, 4) AS norm, 1.0::DOUBLE AS unit FROM n",
    "vector_dim_count": f"WITH {model.SQL} SELECT len(embedding) AS dimension, count(*) AS vectors FROM m_vectors GROUP BY 1",
    "vector_hits_with_chunks": f"""
        WITH {_VECTORS}, top AS (SELECT * FROM scored ORDER BY score DESC, chunk_id LIMIT {POOL})
        SELECT chunk_id, document_id, round(score, 6) AS score, CASE WHEN length(text_content) <= 50 THEN text_content ELSE substr(text_content, 1, 50) || '...' END AS snippet
        FROM top JOIN m_chunks USING (chunk_id)""",
    "hybrid_rrf": f"""
        WITH {_ranked_ctes("f0 > 0 OR f1 > 0 OR f2 > 0", ["w[i] = 'quarry'", "w[i] = 'zephyr'", "w[i] = 'snapshot'"])},
        a AS (SELECT chunk_id, rank, row_number() OVER (ORDER BY rank DESC, chunk_id) AS p FROM ranked ORDER BY rank DESC, chunk_id LIMIT {POOL}),
        q AS (SELECT embedding FROM m_vectors WHERE chunk_id = 0),
        b AS (SELECT v.chunk_id, {_DOT} AS rank FROM m_vectors v, q ORDER BY 2 DESC, 1 LIMIT {POOL}),
        c AS (SELECT chunk_id, rank, row_number() OVER (ORDER BY rank DESC, chunk_id) AS p FROM b),
        e AS (SELECT chunk_id, (1 + 0.1 * {_SIGMOID.format(x="rank", c=20, l=5, r=0.5)}) / (60 + p) AS score, true AS text FROM a
              UNION ALL SELECT chunk_id, {_SIGMOID.format(x="rank", c=0.6, l=0.5, r=5)} / (60 + p), false FROM c),
        g AS (SELECT chunk_id, sum(score) AS score, bool_or(text) AS in_text, bool_or(NOT text) AS in_vector FROM e GROUP BY 1)
        SELECT chunk_id, round(score, 8) AS score, in_text, in_vector FROM g ORDER BY g.score DESC, chunk_id LIMIT 20""",
    "sigmoid_boost": f"SELECT l_orderkey, l_linenumber, round({_SIGMOID.format(x='l_quantity', c=20, l=5, r=0.5)}, 8) AS boost FROM lineitem",
}
