"""The index's data model over the Parquet tables: one row per record, with the names the operators use.

Repeated rows of an id are one record; of versions of a file the newest counts. Repeats of a chunk are the same row; were they
not, the greatest row would count, so every run gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.session import table


def files(spark: SparkSession, sf: str) -> DataFrame:
    newest = F.max(F.struct("modified_at", "file_path", "filename", "size", "content_hash"))
    return table(spark, sf, "files").groupBy(F.col("id").alias("file_id")).agg(newest.alias("n")).select("file_id", "n.file_path", "n.filename", "n.size", "n.modified_at", "n.content_hash")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["file_id", "collection", "slug", "chunk_count", "total_chars", "metadata"]
    return table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), *columns)


def chunks(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """One row per chunk_id, with just the columns asked for, so that no query reads texts it doesn't need."""
    rows = chunk_rows(spark, sf, *columns)
    return rows.groupBy("chunk_id").agg(F.max(F.struct(*columns)).alias("c")).select("chunk_id", "c.*") if columns else rows.distinct()


def chunk_rows(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The rows as they are, repeats included, for those who choose few of them before they sort out repeats."""
    return table(spark, sf, "chunks").select(F.col("id").alias("chunk_id"), *columns)


def tracked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk_vectors").groupBy("chunk_id").agg(F.min("collection").alias("collection"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The table of test vectors, as one collection per label."""
    return table(spark, sf, "embeddings").select(F.concat(F.lit("label-"), F.col("label")).alias("collection"), F.col("vec_id").alias("chunk_id"), "embedding")


SQL = r"""
    m_files AS (SELECT id AS file_id, n.file_path AS file_path, n.filename AS filename, n.size AS size, n.modified_at AS modified_at, n.content_hash AS content_hash FROM (
      SELECT id, max(struct_pack(modified_at := coalesce(modified_at, -1), file_path := file_path, filename := filename, size := size, content_hash := content_hash)) AS n FROM files GROUP BY id)),
    m_documents AS (SELECT doc_id AS document_id, file_id, collection, slug, chunk_count, total_chars, metadata FROM documents),
    m_chunks AS (SELECT DISTINCT id AS chunk_id, document_id, collection, chunk_index, text_content, total_chars, line_start, line_end, section_num, section_title, slug FROM chunks),
    m_tracked AS (SELECT chunk_id, min(collection) AS collection FROM chunk_vectors GROUP BY chunk_id),
    m_vectors AS (SELECT 'label-' || label AS collection, vec_id AS chunk_id, embedding FROM embeddings)"""
