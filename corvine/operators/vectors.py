"""Exact vector search and the upkeep of stored vectors.

Stored vectors have ``collection``, ``chunk_id``, ``embedding``. One query vector is a literal in the plan, so the top rows
come from a TakeOrderedAndProject; many query vectors, a stated set of bounded size, are scored in blocks against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.functions.vectors import inner_product, literal
from corvine.session import prepare

BLOCK_QUERIES = 1_024


def top_k(vectors: DataFrame, query: list[float], k: int, collection: str | None = None) -> DataFrame:
    """(chunk_id, score) of the ``k`` greatest inner products; ties go to the smaller id. Fewer rows than k give them all."""
    if collection is not None:
        vectors = vectors.where(F.col("collection") == collection)
    score = inner_product(F.col("embedding"), literal(query))
    return vectors.select("chunk_id", score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "chunk_id").limit(k)


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, place from 1) for every row of ``queries`` (query_id, embedding).

    The queries are read in blocks of ``BLOCK_QUERIES``, so that what a worker holds is bounded; each worker gives its own
    best ``k`` of a batch, and these are merged. Rows of another length than the query's have no score.
    """
    prepare(vectors.sparkSession)
    rows = vectors.where("embedding IS NOT NULL AND chunk_id IS NOT NULL").select("chunk_id", "embedding")
    best = None
    block: list = []

    def search(block: list) -> DataFrame:
        ids = np.array([q for q, _ in block], dtype=np.int64)
        asked = np.array([v for _, v in block], dtype=np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(1)
                fits = np.flatnonzero(np.diff(column.offsets.to_numpy()) == asked.shape[1])
                if not len(fits):
                    continue
                own = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(len(fits), -1).astype(np.float64)
                chunk = batch.column(0).to_numpy()[fits]
                score = asked @ own.T
                order = np.lexsort((np.broadcast_to(chunk, score.shape), -score), axis=1)[:, :k]
                row = np.repeat(np.arange(len(ids)), order.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(chunk[order.ravel()]), pa.array(score[row, order.ravel()])], names=["query_id", "chunk_id", "score"])

        return rows.mapInArrow(run, "query_id long, chunk_id long, score double")

    for q in queries.where("embedding IS NOT NULL AND query_id IS NOT NULL").select("query_id", "embedding").toLocalIterator():
        block.append((q[0], q[1]))
        if len(block) == BLOCK_QUERIES:
            best, block = (search(block) if best is None else best.unionByName(search(block))), []
    if block:
        best = search(block) if best is None else best.unionByName(search(block))
    if best is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double, place int")
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "chunk_id"))), 1, k)
    merged = best.where("NOT isnan(score)").groupBy("query_id").agg(first.alias("best"))
    out = merged.select("query_id", F.posexplode("best").alias("place", "b"))
    return out.select("query_id", F.col("b.chunk_id").alias("chunk_id"), (-F.col("b.minus")).alias("score"), (F.col("place") + 1).alias("place"))


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Top hits with their chunks' columns; a hit whose chunk is gone is dropped after it has taken its place.

    Repeated rows of a chunk are one, of other versions the greatest; they are sorted out after the join.
    """
    others = [c for c in chunks.columns if c != "chunk_id"]
    found = chunks.join(hits, "chunk_id").groupBy(*hits.columns).agg(F.max(F.struct(*others)).alias("_c"))
    return found.select(*hits.columns, "_c.*").orderBy(F.desc("score"), "chunk_id")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows, and those stored under other ids."""
    return stored.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def remove(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the rows of ``ids``; ids that aren't stored don't matter."""
    return stored.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def mark(tracked: DataFrame, new: DataFrame) -> DataFrame:
    """Add tracking rows; an id that is tracked keeps its row, and of several new rows the smallest collection counts."""
    fresh = new.groupBy("chunk_id").agg(F.min("collection").alias("collection")).join(tracked.select("chunk_id"), "chunk_id", "left_anti")
    return tracked.unionByName(fresh.select(*tracked.columns))


def without_collection(rows: DataFrame, collection: str) -> DataFrame:
    return rows.where(~F.col("collection").eqNullSafe(F.lit(collection)))


def orphans(tracked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tracked or stored rows whose chunk is gone."""
    return tracked.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def pruned(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    return stored.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def dimensions(vectors: DataFrame) -> DataFrame:
    """(dimension, vectors): how many stored vectors have which length."""
    return vectors.groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("vectors"))
