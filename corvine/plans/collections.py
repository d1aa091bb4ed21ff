"""Snapshot comparison, listings and upkeep of vectors over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators import catalog, sync, vectors
from corvine.operators.incremental import committed_from_log
from corvine.plans import model
from corvine.session import table


def _scan(spark: SparkSession, sf: str) -> DataFrame:
    return model.files(spark, sf).select("file_path", "modified_at", F.lower("content_hash").alias("content_hash"))


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    committed = committed_from_log(table(spark, sf, "indexed_files"), table(spark, sf, "sync_runs"))
    return committed.select(F.col("key").alias("file_path"), F.col("version").alias("modified_at"), F.col("hash").alias("content_hash"))


def sync_diff_states(spark: SparkSession, sf: str) -> DataFrame:
    return sync.states(_scan(spark, sf), _stored(spark, sf)).select("file_path", "state", "refresh")


def sync_result_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sync.tallies(sync.states(_scan(spark, sf), _stored(spark, sf)))


def sync_moved(spark: SparkSession, sf: str) -> DataFrame:
    return sync.states(_scan(spark, sf), _stored(spark, sf)).where("state = 'moved'").select("file_path", "old_hash")


def sync_verified(spark: SparkSession, sf: str) -> DataFrame:
    return sync.states(_scan(spark, sf), _stored(spark, sf), verify_hash=True, prune=False).groupBy("state").agg(F.count("*").alias("paths"))


def _gone(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "removals").where("table_name = 'files' AND restored_at IS NULL").select(F.col("row_id").alias("file_id")).distinct()


def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    kept = sync.cascade(model.files(spark, sf), model.documents(spark, sf), model.chunks(spark, sf, "document_id"), _gone(spark, sf))
    keys = (("files", "file_id"), ("documents", "document_id"), ("chunks", "chunk_id"))
    counts = [t.agg(F.count("*").alias("rows"), F.sum(key).alias("sum_ids")).select(F.lit(n).alias("table_name"), "rows", "sum_ids") for t, (n, key) in zip(kept, keys)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def sync_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that stay once the documents of removed files are gone."""
    _, _, chunks = sync.cascade(model.files(spark, sf), model.documents(spark, sf), model.chunks(spark, sf, "document_id"), _gone(spark, sf))
    return chunks.select("chunk_id")


def orphan_documents(spark: SparkSession, sf: str) -> DataFrame:
    return sync.orphan_documents(model.documents(spark, sf), model.files(spark, sf)).select("document_id", "file_id")


def stats_totals(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.totals(model.files(spark, sf), model.documents(spark, sf), model.chunks(spark, sf, "total_chars"))


def stats_per_collection(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.per_collection(model.documents(spark, sf), model.chunks(spark, sf, "document_id", "total_chars"))


def stats_config_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    configured = spark.createDataFrame([("platform-handbook",), ("not-indexed-yet",), ("runner-release",)], "collection string")
    return catalog.reconciled(configured, model.documents(spark, sf).where("collection IS NOT NULL").groupBy("collection").agg(F.count("*").alias("documents")))


def files_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.files_of(model.files(spark, sf), model.documents(spark, sf), "platform-handbook")
    return catalog.page(rows, 20, 5, ("file_path", "slug")).select("file_path", "slug", "chunk_count", "total_chars", "metadata")


def files_all(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.files_of(model.files(spark, sf), model.documents(spark, sf)).select("file_path", "slug", "chunk_count", "total_chars", "metadata")


def files_total(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.files_of(model.files(spark, sf), model.documents(spark, sf), "platform-handbook").agg(F.count("*").alias("total"))


def orphan_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.orphans(model.tracked(spark, sf), model.chunks(spark, sf)).select("chunk_id", "collection")


def orphan_vectors_by_collection(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.orphans(model.tracked(spark, sf), model.chunks(spark, sf)).groupBy("collection").agg(F.count("*").alias("orphans"))


def pending_embed(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.pending(model.chunk_rows(spark, sf, "text_content"), model.tracked(spark, sf)).select("chunk_id").distinct()


def vector_prune(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.pruned(model.vectors(spark, sf), model.chunks(spark, sf)).select("chunk_id", "collection")


def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The newest finite results of the embedding job over the test vectors."""
    fine = (F.size("vector") == 64) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    new = table(spark, sf, "embedresult").where("id IS NOT NULL").where(fine).groupBy(F.col("id").alias("chunk_id")).agg(F.max(F.struct("finished_at", "vector")).alias("n"))
    out = vectors.upsert(model.vectors(spark, sf), new.select(F.lit("results").alias("collection"), "chunk_id", F.col("n.vector").alias("embedding")))
    return out.select("chunk_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


def vector_mark(spark: SparkSession, sf: str) -> DataFrame:
    tracked = model.tracked(spark, sf)
    new = model.chunks(spark, sf, "collection")
    return vectors.mark(tracked, new).select("chunk_id", "collection")


def vector_clear(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.without_collection(model.tracked(spark, sf), "platform-handbook").select("chunk_id", "collection")


def result_file_enrich(spark: SparkSession, sf: str) -> DataFrame:
    hits = model.tracked(spark, sf).select("chunk_id")
    return catalog.enriched(hits, model.chunks(spark, sf, *catalog.ENRICHING), model.documents(spark, sf), model.files(spark, sf)).select("chunk_id", "document_id", "file_path", "line_start", "line_end")


QUERIES = {
    f.__name__: f
    for f in (
        sync_diff_states, sync_result_counts, sync_moved, sync_verified, cascade_delete, sync_prune, orphan_documents, stats_totals, stats_per_collection, stats_config_reconcile,
        files_page, files_all, files_total, orphan_vectors, orphan_vectors_by_collection, pending_embed, vector_prune, vector_upsert, vector_mark, vector_clear, result_file_enrich,
    )
}

_SYNC = rf"""{model.SQL},
    scan AS (SELECT file_path, nullif(modified_at, -1) AS modified_at, lower(content_hash) AS content_hash FROM m_files),
    stored AS (SELECT file_path, n.v AS modified_at, n.h AS content_hash FROM (
      SELECT regexp_replace(file_path, '^(\./)+', '') AS file_path, max(struct_pack(r := i.run_id, v := i.modified_at, h := lower(content_hash))) AS n
      FROM indexed_files i JOIN (SELECT DISTINCT run_id FROM sync_runs WHERE status = 'ok') r USING (run_id) GROUP BY 1)),
    j AS (SELECT coalesce(c.file_path, s.file_path) AS file_path, c.content_hash, s.content_hash AS old_hash, c.modified_at IS NOT DISTINCT FROM s.modified_at AS same_time,
                 c.content_hash IS NOT DISTINCT FROM s.content_hash AS same_hash, s.file_path IS NULL AS no_old, c.file_path IS NULL AS no_new
          FROM scan c FULL JOIN stored s USING (file_path)),
    k AS (SELECT *, CASE WHEN no_old THEN 'added' WHEN no_new THEN 'gone' WHEN same_time OR same_hash THEN 'unchanged' ELSE 'modified' END AS s FROM j),
    states AS (SELECT *, CASE WHEN s <> 'gone' THEN s WHEN old_hash IN (SELECT content_hash FROM k WHERE s IN ('added', 'modified') AND content_hash IS NOT NULL) THEN 'moved' ELSE 'deleted' END AS state,
                      s = 'unchanged' AND NOT same_time AS refresh FROM k)"""
_GONE = "gone AS (SELECT DISTINCT row_id FROM removals WHERE table_name = 'files' AND restored_at IS NULL)"
_KEPT = f"""{model.SQL}, {_GONE}, lost AS (SELECT document_id FROM m_documents WHERE file_id IN (SELECT row_id FROM gone)),
    kept AS (SELECT chunk_id FROM m_chunks WHERE document_id IS NULL OR document_id NOT IN (SELECT document_id FROM lost))"""
_LISTED = "SELECT file_path, slug, chunk_count, total_chars, coalesce(metadata, '') AS metadata FROM m_documents JOIN m_files USING (file_id)"

SQL = {
    "sync_diff_states": f"WITH {_SYNC} SELECT file_path, state, refresh FROM states",
    "sync_result_counts": f"""
        WITH {_SYNC}, landed AS (SELECT content_hash, arg_max(state, file_path) AS state FROM states WHERE state IN ('added', 'modified') GROUP BY 1),
        off AS (SELECT l.state FROM (SELECT DISTINCT old_hash FROM states WHERE state = 'moved') m JOIN landed l ON l.content_hash = m.old_hash),
        n AS (SELECT state, count(*) AS n FROM states GROUP BY 1)
        SELECT coalesce((SELECT n FROM n WHERE state = 'unchanged'), 0) AS unchanged,
               coalesce((SELECT n FROM n WHERE state = 'added'), 0) - (SELECT count(*) FROM off WHERE state = 'added') AS added,
               coalesce((SELECT n FROM n WHERE state = 'modified'), 0) - (SELECT count(*) FROM off WHERE state = 'modified') AS modified,
               coalesce((SELECT n FROM n WHERE state = 'moved'), 0) AS moved, coalesce((SELECT n FROM n WHERE state = 'deleted'), 0) AS deleted""",
    "sync_moved": f"WITH {_SYNC} SELECT file_path, old_hash FROM states WHERE state = 'moved'",
    "sync_verified": f"WITH {_SYNC} SELECT CASE WHEN no_old THEN 'added' WHEN same_hash THEN 'unchanged' ELSE 'modified' END AS state, count(*) AS paths FROM j WHERE NOT no_new GROUP BY 1",
    "cascade_delete": f"""
        WITH {_KEPT} SELECT 'files' AS table_name, count(*) AS rows, sum(file_id)::BIGINT AS sum_ids FROM m_files WHERE file_id NOT IN (SELECT row_id FROM gone)
        UNION ALL SELECT 'documents', count(*), sum(document_id)::BIGINT FROM m_documents WHERE file_id IS NULL OR file_id NOT IN (SELECT row_id FROM gone)
        UNION ALL SELECT 'chunks', count(*), sum(chunk_id)::BIGINT FROM kept""",
    "sync_prune": f"WITH {_KEPT} SELECT chunk_id FROM kept",
    "orphan_documents": f"WITH {model.SQL} SELECT document_id, file_id FROM m_documents WHERE file_id IS NOT NULL AND file_id NOT IN (SELECT file_id FROM m_files)",
    "stats_totals": f"""
        WITH {model.SQL} SELECT (SELECT count(*) FROM m_files) AS total_files, (SELECT count(*) FROM m_documents) AS total_documents, (SELECT count(DISTINCT collection) FROM m_documents) AS collections_count,
               (SELECT count(*) FROM m_chunks) AS total_chunks, (SELECT coalesce(sum(total_chars), 0)::BIGINT FROM m_chunks) AS total_chars""",
    "stats_per_collection": f"""
        WITH {model.SQL}, k AS (SELECT d.collection, count(*) AS chunks, sum(c.total_chars)::BIGINT AS chars FROM m_chunks c JOIN m_documents d USING (document_id) GROUP BY 1)
        SELECT d.collection, documents, coalesce(chunks, 0) AS chunks, coalesce(chars, 0) AS chars FROM (SELECT collection, count(*) AS documents FROM m_documents GROUP BY 1) d LEFT JOIN k ON d.collection IS NOT DISTINCT FROM k.collection""",
    "stats_config_reconcile": """
        WITH c AS (SELECT unnest(['platform-handbook', 'not-indexed-yet', 'runner-release']) AS collection), n AS (SELECT collection, count(*) AS documents FROM documents WHERE collection IS NOT NULL GROUP BY 1)
        SELECT collection, collection IN (SELECT collection FROM c) AS in_config, coalesce(documents, 0) AS documents FROM c FULL JOIN n USING (collection)""",
    "files_page": f"WITH {model.SQL} {_LISTED} WHERE collection = 'platform-handbook' ORDER BY file_path, slug LIMIT 20 OFFSET 5",
    "files_all": f"WITH {model.SQL} {_LISTED}",
    "files_total": f"WITH {model.SQL} SELECT count(*) AS total FROM m_documents JOIN m_files USING (file_id) WHERE collection = 'platform-handbook'",
    "orphan_vectors": f"WITH {model.SQL} SELECT chunk_id, collection FROM m_tracked WHERE chunk_id NOT IN (SELECT chunk_id FROM m_chunks)",
    "orphan_vectors_by_collection": f"WITH {model.SQL} SELECT collection, count(*) AS orphans FROM m_tracked WHERE chunk_id NOT IN (SELECT chunk_id FROM m_chunks) GROUP BY 1",
    "pending_embed": rf"WITH {model.SQL} SELECT chunk_id FROM m_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM m_tracked) AND strlen(regexp_replace(regexp_replace(coalesce(text_content, ''), '^[\s\x{{b}}\p{{Z}}\x{{85}}]+', ''), '[\s\x{{b}}\p{{Z}}\x{{85}}]+$', '')) >= 3",
    "vector_prune": f"WITH {model.SQL} SELECT chunk_id, collection FROM m_vectors WHERE chunk_id IN (SELECT chunk_id FROM m_chunks)",
    "vector_upsert": f"""
        WITH {model.SQL}, fine AS (
          SELECT id AS chunk_id, max(struct_pack(f := coalesce(finished_at, TIMESTAMP '0001-01-01'), v := vector)).v AS v FROM embedresult
          WHERE id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY id),
        every AS (SELECT chunk_id, v FROM fine UNION ALL SELECT chunk_id, embedding FROM m_vectors WHERE chunk_id NOT IN (SELECT chunk_id FROM fine))
        SELECT chunk_id, round(list_sum(list_transform(v, lambda x: x::DOUBLE)), 5) AS total FROM every""",
    "vector_mark": f"WITH {model.SQL} SELECT chunk_id, CASE WHEN t.chunk_id IS NULL THEN c.collection ELSE t.collection END AS collection FROM m_tracked t FULL JOIN (SELECT chunk_id, collection FROM m_chunks) c USING (chunk_id)",
    "vector_clear": f"WITH {model.SQL} SELECT chunk_id, collection FROM m_tracked WHERE collection IS DISTINCT FROM 'platform-handbook'",
    "result_file_enrich": f"""
        WITH {model.SQL} SELECT t.chunk_id, c.document_id, f.file_path, c.line_start, c.line_end
        FROM m_tracked t JOIN m_chunks c USING (chunk_id) JOIN m_documents d USING (document_id) JOIN m_files f USING (file_id)""",
}
