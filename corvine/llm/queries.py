"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import leaks, markup, neighbours, provenance, repetition, secrets, spans, tokenize
from corvine.session import table


def p1_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf, "chunks"), "text_content", "id").withColumnRenamed("id", "chunk_id")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_spans(spark, sf).select("chunk_id")


def p2_clean(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.regexp_extract(F.lower("slug"), r"-([a-z0-9_]+)--[0-9]+$", 1)
    prose = table(spark, sf, "chunks").where(kind.isin(*markup.PROSE))
    return markup.cleaned(prose, "text_content", "section_title", "id").withColumnRenamed("id", "chunk_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_clean(spark, sf).where("marked").select("chunk_id").distinct()


def _tracked_vectors(spark: SparkSession, sf: str) -> DataFrame:
    tracked = table(spark, sf, "chunk_vectors").select(F.col("chunk_id").alias("id"), "collection").distinct()
    return neighbours.latest_vectors(table(spark, sf, "embedresult")).join(tracked, "id")


def p3_neighbours(spark: SparkSession, sf: str, least: float = 0.9) -> DataFrame:
    found = neighbours.neighbours(_tracked_vectors(spark, sf), k=5, least=least, sample_from=table(spark, sf, "embedresult"))
    return found.select("collection", F.col("id").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"), F.round("similarity", 6).alias("similarity"), "place")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = p3_neighbours(spark, sf)
    return pairs.select(F.least("chunk_id", "neighbour_id").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_id_b")).distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_redacted(spark, sf).select("chunk_id", "line_no")


def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.credentials(table(spark, sf, "chunks"), "text_content", "id").withColumnRenamed("id", "chunk_id")


def p4_masked(spark: SparkSession, sf: str) -> DataFrame:
    """The whole masked text of every chunk that holds a secret."""
    return secrets.masked(table(spark, sf, "chunks"), "text_content", "id").withColumnRenamed("id", "chunk_id").withColumnRenamed("masked", "text")


def p5_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.not_handwritten(*(table(spark, sf, t) for t in ("files", "documents", "chunks")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_kinds(spark, sf).select("file_id")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.encode(table(spark, sf, "documents"), "text", "doc_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked(p9_tiles(spark, sf)).select("doc_id", "item_id")


def p9_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), "text", "doc_id", table(spark, sf, "eval_items"))


def p9_reordered(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold half of an item's words or more in runs of five, also in another order."""
    found = leaks.leaks(table(spark, sf, "documents"), "text", "doc_id", table(spark, sf, "eval_items"), run=leaks.TILE)
    return leaks.covered(found).select("doc_id", "item_id", F.round("coverage", 9).alias("coverage"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.repetitive(table(spark, sf, "documents"), "text", "doc_id").select("doc_id")


def p10_measure(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.measure(table(spark, sf, "documents"), "text", "doc_id").select("doc_id", *(F.round(c, 9).alias(c) for c in ("run_share", "line_share", "paragraph_share")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_spans, p2_found, p2_clean, p3_found, p3_neighbours, p4_found, p4_redacted, p4_masked, p5_found, p5_kinds, p8_ids, p9_found, p9_tiles, p9_reordered, p10_found, p10_measure)}
