"""Ids for new rows, above all that were ever given out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.session import materialize


def allocated(rows: DataFrame, column: str, first: int, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with consecutive ids from ``first`` in ``order``, and the next free id.

    The rows are range-partitioned and written once, so that their partitions stay; partitions are counted (one number
    each reaches the driver) and number their rows from where the ones before them end.
    """
    placed = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ids")
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    offsets, at = {}, first
    for part, n in counts:
        offsets[part], at = at, at + n
    if not offsets:
        return placed.drop("_part").withColumn(column, F.lit(None).cast("long")), first
    table = rows.sparkSession.createDataFrame(list(offsets.items()), "_part int, _first long")
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.join(F.broadcast(table), "_part").withColumn(column, (F.col("_first") + number).cast("long")).drop("_part", "_first"), at
