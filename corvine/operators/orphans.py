"""References to records that don't exist, by compressed bitmaps.

Keys become integers; an integer's upper bits name a key range and its lower 16 bits a place in the range's bitmap. Per
reference table, key range and period there is one bitmap of the keys referred to, per parent table and key range one of
the keys present; reference AND-NOT parent leaves the dangling keys, which are decoded and joined back to their rows.
A bitmap never has more than 65 536 places, however often a key is referred to, and partial sets are merged before the
shuffle, so a hot key weighs no more than any other.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.session import prepare

LOW_BITS = 16
PLACES = 1 << LOW_BITS
ARRAY_MOST = 4096  # up to so many places a sorted list is shorter than the bits


def pack(places: np.ndarray) -> bytes:
    """A compressed bitmap: a tag, then sorted 16-bit places or the bits, deflated."""
    places = np.unique(np.asarray(places, dtype=np.uint16))
    if len(places) <= ARRAY_MOST:
        return b"a" + zlib.compress(places.astype("<u2").tobytes(), 1)
    bits = np.zeros(PLACES, dtype=bool)
    bits[places] = True
    return b"b" + zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack(bitmap: bytes | None) -> np.ndarray:
    """The bits of a bitmap as booleans; none set for None."""
    bits = np.zeros(PLACES, dtype=bool)
    if bitmap is None:
        return bits
    body = zlib.decompress(bitmap[1:])
    if bitmap[:1] == b"b":
        return np.unpackbits(np.frombuffer(body, dtype=np.uint8)).astype(bool)
    bits[np.frombuffer(body, dtype="<u2")] = True
    return bits


@F.pandas_udf(T.BinaryType())
def _pack(places: pd.Series) -> pd.Series:
    return pd.Series([pack(np.asarray(p)) for p in places], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _and_not(references: pd.Series, present: pd.Series) -> pd.Series:
    return pd.Series([np.flatnonzero(unpack(r) & ~unpack(p)).astype(np.int32) for r, p in zip(references, present)], dtype=object)


def encode_keys(keys: DataFrame, column: str) -> DataFrame:
    """Dictionary (key, code long) of the distinct non-null keys; whole numbers are their own codes.

    Other keys are range-partitioned and numbered within their partition, then written to the shared folder, since the
    numbers have to stay the same if a task is run again.
    """
    distinct = keys.where(F.col(column).isNotNull()).select(F.col(column).alias("key")).distinct()
    if isinstance(keys.schema[column].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return distinct.select("key", F.col("key").cast("long").alias("code"))
    prepare(keys.sparkSession)
    return distinct.repartitionByRange("key").withColumn("code", F.monotonically_increasing_id()).checkpoint()


def bitmaps(codes: DataFrame, by: list[str]) -> DataFrame:
    """One bitmap per key range and per value of ``by`` of the column ``code``."""
    return (
        codes.select(*by, F.shiftright("code", LOW_BITS).alias("range"), F.col("code").bitwiseAND(PLACES - 1).cast("int").alias("place"))
        .groupBy(*by, "range")
        .agg(F.collect_set("place").alias("places"))
        .select(*by, "range", _pack("places").alias("bitmap"))
    )


def period_of(column: str):
    return F.coalesce(F.date_format(column, "yyyy-MM"), F.lit("none"))


def dangling(references: DataFrame, present: DataFrame) -> DataFrame:
    """Reference rows without a parent.

    ``references``: table_name, row_id, period, parent, key long; ``present``: parent, key long. Null keys refer to
    nothing and are never cases; rows given more than once come out once; an empty parent table leaves every key dangling.
    """
    rows = references.where(F.col("key").isNotNull()).select("table_name", "row_id", "period", "parent", "key").distinct()
    asked = bitmaps(rows.select("table_name", "parent", "period", F.col("key").alias("code")), ["table_name", "parent", "period"])
    there = bitmaps(present.where(F.col("key").isNotNull()).select("parent", F.col("key").alias("code")), ["parent"])
    missing = (
        asked.join(there.withColumnRenamed("bitmap", "present"), ["parent", "range"], "left")
        .select("table_name", "period", "range", F.explode(_and_not("bitmap", "present")).alias("place"))
        .select("table_name", "period", (F.shiftleft("range", LOW_BITS) + F.col("place")).alias("key"))
    )
    return rows.join(missing, ["table_name", "period", "key"], "left_semi").select("table_name", "row_id", "period", "key")


def dangling_references(files: DataFrame, documents: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, removals: DataFrame) -> DataFrame:
    """Dangling references of the document tables: table_name, row_id, period, key.

    A removal counts until it is restored, whether or not the removed row is still in its table.
    """

    def refs(df: DataFrame, name: str, row: str, key: str, at: str, parent: str) -> DataFrame:
        return df.select(F.lit(name).alias("table_name"), F.col(row).alias("row_id"), period_of(at).alias("period"), F.lit(parent).alias("parent"), F.col(key).cast("long").alias("key"))

    references = (
        refs(documents, "documents", "doc_id", "file_id", "indexed_at", "files")
        .unionByName(refs(chunks, "chunks", "id", "document_id", "indexed_at", "documents"))
        .unionByName(refs(chunk_vectors, "chunk_vectors", "chunk_id", "chunk_id", "embedded_at", "chunks"))
    )
    removed = removals.where(F.col("restored_at").isNull()).select(F.col("table_name").alias("parent"), F.col("row_id").alias("key")).distinct()
    rows = lambda df, name, key: df.select(F.lit(name).alias("parent"), F.col(key).cast("long").alias("key"))
    present = rows(files, "files", "id").unionByName(rows(documents, "documents", "doc_id")).unionByName(rows(chunks, "chunks", "id"))
    return dangling(references, present.join(removed, ["parent", "key"], "left_anti"))
