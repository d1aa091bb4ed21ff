"""The queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvine.plans import collections, search, texts, upkeep

FLAGSHIP = "hybrid_rrf"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return search.QUERIES | texts.QUERIES | collections.QUERIES | upkeep.QUERIES
