"""Upkeep of the document tables: what changed, and what refers to nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators import incremental, orphans
from corvine.session import scratch_path, table


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The log of runs becomes the first version of a state, and the current files are compared with what is in force."""
    state = incremental.StateStore(spark, scratch_path(spark, "state", keep=False))
    state.commit(incremental.committed_from_log(table(spark, sf, "indexed_files"), table(spark, sf, "sync_runs")))
    return state.changes(incremental.newest_versions(table(spark, sf, "files"))).select(F.col("key").alias("file_path"))


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.dangling_references(*(table(spark, sf, t) for t in ("files", "documents", "chunks", "chunk_vectors", "removals")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("table_name", "row_id", "period")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).groupBy("table_name", "period").agg(F.count("*").alias("orphan_rows"), F.countDistinct("key").alias("missing_keys"))


QUERIES = {f.__name__: f for f in (p6_found, p7_found, p7_report)}

_DANGLING = """
  present AS (
    SELECT 'files' AS parent, id AS key FROM files UNION SELECT 'documents', doc_id FROM documents UNION SELECT 'chunks', id FROM chunks
    EXCEPT SELECT table_name, row_id FROM removals WHERE restored_at IS NULL),
  refs AS (
    SELECT 'documents' AS table_name, doc_id AS row_id, coalesce(strftime(indexed_at, '%Y-%m'), 'none') AS period, 'files' AS parent, file_id AS key FROM documents
    UNION SELECT 'chunks', id, coalesce(strftime(indexed_at, '%Y-%m'), 'none'), 'documents', document_id FROM chunks
    UNION SELECT 'chunk_vectors', chunk_id, coalesce(strftime(embedded_at, '%Y-%m'), 'none'), 'chunks', chunk_id FROM chunk_vectors),
  dangling AS (SELECT refs.* FROM refs LEFT JOIN present USING (parent, key) WHERE refs.key IS NOT NULL AND present.key IS NULL)"""

SQL = {
    "p6_found": r"""
        WITH now AS (
          SELECT file_path, max(struct_pack(v := coalesce(modified_at, -9223372036854775808), h := coalesce(lower(content_hash), ''))) AS n
          FROM files WHERE file_path IS NOT NULL GROUP BY 1),
        was AS (
          SELECT regexp_replace(file_path, '^(\./)+', '') AS file_path, max(struct_pack(r := run_id, v := i.modified_at, h := lower(content_hash))) AS s
          FROM indexed_files i JOIN (SELECT DISTINCT run_id FROM sync_runs WHERE status = 'ok') r USING (run_id) GROUP BY 1)
        SELECT now.file_path FROM now LEFT JOIN was USING (file_path)
        WHERE s IS NULL OR CASE WHEN n.h = '' THEN n.v IS DISTINCT FROM s.v ELSE n.h IS DISTINCT FROM s.h END""",
    "p7_found": f"WITH {_DANGLING} SELECT table_name, row_id, period FROM dangling",
    "p7_report": f"WITH {_DANGLING} SELECT table_name, period, count(*) AS orphan_rows, count(DISTINCT key) AS missing_keys FROM dangling GROUP BY 1, 2",
}
