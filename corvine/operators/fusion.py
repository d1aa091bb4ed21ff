"""Hybrid ranking: reciprocal ranks of two hit lists, weighted by sigmoids of their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions.text import sigmoid

# Where the weights turn, and how steep they are below and above.
TEXT_CENTER, TEXT_LEFT, TEXT_RIGHT, TEXT_SHARE = 20.0, 5.0, 0.5, 0.1
VECTOR_CENTER, VECTOR_LEFT, VECTOR_RIGHT = 0.6, 0.5, 5.0
RRF_K = 60


def text_weight(rank: Column) -> Column:
    return 1 + F.lit(TEXT_SHARE) * sigmoid(rank, TEXT_CENTER, TEXT_LEFT, TEXT_RIGHT)


def vector_weight(score: Column) -> Column:
    return sigmoid(score, VECTOR_CENTER, VECTOR_LEFT, VECTOR_RIGHT)


def fused(text_hits: DataFrame, vector_hits: DataFrame, limit: int, rrf_k: int = RRF_K) -> DataFrame:
    """(chunk_id, score, in_text, in_vector), the best ``limit``; ties go to the smaller id.

    Both lists have (chunk_id, rank) and are bounded pools of search results; places count from 0 by descending rank.
    """
    order = Window.orderBy(F.desc("rank"), "chunk_id")  # pools of a few times the limit

    def side(hits: DataFrame, weight: Column, text: bool) -> DataFrame:
        place = F.row_number().over(order) - 1
        return hits.select("chunk_id", "rank").withColumn("place", place).select("chunk_id", (weight / (rrf_k + F.col("place") + 1)).alias("score"), F.lit(text).alias("text"))

    both = side(text_hits, text_weight(F.col("rank")), True).unionByName(side(vector_hits, vector_weight(F.col("rank")), False))
    total = both.groupBy("chunk_id").agg(F.sum("score").alias("score"), F.max("text").alias("in_text"), F.max(~F.col("text")).alias("in_vector"))
    return total.orderBy(F.desc("score"), "chunk_id").limit(limit)
