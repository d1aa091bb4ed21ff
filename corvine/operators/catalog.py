"""Listings and figures about what is indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(files: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: total_files, total_documents, total_chunks, total_chars, collections_count; zeros for empty tables."""
    one = files.agg(F.count("*").alias("total_files"))
    one = one.crossJoin(documents.agg(F.count("*").alias("total_documents"), F.count_distinct("collection").alias("collections_count")))  # single rows
    return one.crossJoin(chunks.agg(F.count("*").alias("total_chunks"), F.coalesce(F.sum("total_chars"), F.lit(0)).alias("total_chars")))


def per_collection(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """collection, documents, chunks, chars; chunks count in their document's collection."""
    own = chunks.join(documents.select("document_id", F.col("collection").alias("_c")), "document_id").groupBy(F.col("_c").alias("collection")).agg(F.count("*").alias("chunks"), F.coalesce(F.sum("total_chars"), F.lit(0)).alias("chars"))
    counts = documents.groupBy("collection").agg(F.count("*").alias("documents"))
    joined = counts.join(own, counts.collection.eqNullSafe(own.collection), "left").select(counts.collection, "documents", "chunks", "chars")
    return joined.fillna(0, ["chunks", "chars"])


def reconciled(configured: DataFrame, counted: DataFrame) -> DataFrame:
    """Configured collections with their counts (0 if there is nothing), and those that only the tables know."""
    c = configured.select(F.col("collection").alias("name"), F.lit(True).alias("configured"))
    joined = c.join(counted, F.col("name") == F.col("collection"), "full")
    return joined.select(F.coalesce("name", "collection").alias("collection"), F.coalesce("configured", F.lit(False)).alias("in_config"), F.coalesce("documents", F.lit(0)).alias("documents"))


def files_of(files: DataFrame, documents: DataFrame, collection: str | None = None) -> DataFrame:
    """file_path, slug, chunk_count, total_chars, metadata (empty for null) of a collection's documents."""
    own = documents if collection is None else documents.where(F.col("collection") == collection)
    return own.join(files.select("file_id", "file_path"), "file_id").select("file_path", "slug", "chunk_count", "total_chars", F.coalesce("metadata", F.lit("")).alias("metadata"))


def page(rows: DataFrame, limit: int = 0, offset: int = 0, order: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """A page in order; a limit of 0 or less means all rows, whatever the offset."""
    rows = rows.orderBy(*order)
    return rows.offset(offset).limit(limit) if limit > 0 else rows


def banner(limit: int, offset: int, total: int) -> str:
    """What a listing says of the part it shows; empty if it shows all."""
    shown = limit > 0 and (offset > 0 or limit < total)
    return f"Showing {offset + 1}-{min(offset + limit, total)} of {total}" if shown else ""


def pending(chunks: DataFrame, tracked: DataFrame, worth: bool = True) -> DataFrame:
    """Chunks that no vector is tracked for; texts of under three bytes but for white space are not worth one."""
    from corvine.functions.text import worth_embedding

    own = chunks.where(worth_embedding(F.col("text_content"))) if worth else chunks
    return own.join(tracked.select("chunk_id"), "chunk_id", "left_anti")


ENRICHING = ("document_id", "line_start", "line_end", "section_title", "slug")


def enriched(hits: DataFrame, chunks: DataFrame, documents: DataFrame, files: DataFrame) -> DataFrame:
    """Hits (chunk_id, ...) with document_id, slug, line range and file_path; a hit that leads to no file is left out."""
    own = chunks.select("chunk_id", "document_id", "line_start", "line_end", "section_title", F.col("slug").alias("chunk_slug"))
    return hits.join(own, "chunk_id").join(documents.select("document_id", "file_id"), "document_id").join(files.select("file_id", "file_path"), "file_id")
