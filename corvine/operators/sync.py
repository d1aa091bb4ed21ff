"""Snapshot comparison: what of a collection is unchanged, added, modified, moved or deleted.

The scan (file_path, modified_at, content_hash) and what is stored meet in one full outer join. Equal times or equal hashes
mean unchanged; a stored path that the scan lacks is moved if its content came in under a new or modified path, else deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("unchanged", "added", "modified", "moved", "deleted")


def states(scan: DataFrame, stored: DataFrame, verify_hash: bool = False, prune: bool = True) -> DataFrame:
    """(file_path, state, content_hash, modified_at, old_hash, refresh) of every path on either side.

    ``verify_hash`` looks at the hash even if the times are equal. ``refresh`` marks unchanged files of another time.
    Without ``prune``, paths that the scan lacks don't come out.
    """
    c, s = scan.alias("c"), stored.alias("s")
    same_time = F.col("s.modified_at").eqNullSafe(F.col("c.modified_at"))
    same_hash = F.col("s.content_hash").eqNullSafe(F.col("c.content_hash"))
    same = same_hash if verify_hash else same_time | same_hash
    state = F.when(F.col("s.file_path").isNull(), "added").when(F.col("c.file_path").isNull(), "gone").when(same, "unchanged").otherwise("modified")
    joined = c.join(s, F.col("c.file_path") == F.col("s.file_path"), "full" if prune else "left").select(
        F.coalesce("c.file_path", "s.file_path").alias("file_path"), state.alias("state"), F.col("c.content_hash").alias("content_hash"), F.col("c.modified_at").alias("modified_at"),
        F.col("s.content_hash").alias("old_hash"), (F.col("s.file_path").isNotNull() & F.col("c.file_path").isNotNull() & same & ~same_time).alias("refresh"),
    )
    if not prune:
        return joined
    arrived = joined.where(F.col("state").isin("added", "modified") & F.col("content_hash").isNotNull()).select(F.col("content_hash").alias("old_hash")).distinct().withColumn("arrived", F.lit(True))
    moved = F.when(F.col("state") != "gone", F.col("state")).when(F.col("arrived"), "moved").otherwise("deleted")
    return joined.join(arrived, "old_hash", "left").withColumn("state", moved).select(*joined.columns)


def tallies(states: DataFrame) -> DataFrame:
    """One row of counts per state.

    Each content that moved is taken off the state it arrived in once, however many copies went or came; if it arrived as
    both, off the one whose path sorts last.
    """
    landed = states.where(F.col("state").isin("added", "modified")).groupBy(F.col("content_hash").alias("old_hash")).agg(F.max_by("state", "file_path").alias("landed"))
    moved = states.where("state = 'moved'").select("old_hash").distinct().join(landed, "old_hash")
    off = moved.agg(*[F.coalesce(F.sum((F.col("landed") == s).cast("long")), F.lit(0)).alias(f"off_{s}") for s in ("added", "modified")])
    counts = states.agg(*[F.coalesce(F.sum((F.col("state") == s).cast("long")), F.lit(0)).alias(s) for s in STATES])
    both = counts.crossJoin(off)  # one row each
    return both.select("unchanged", (F.col("added") - F.col("off_added")).alias("added"), (F.col("modified") - F.col("off_modified")).alias("modified"), "moved", "deleted")


def cascade(files: DataFrame, documents: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the files of ``gone`` (file_id), their documents and the documents' chunks."""
    dropped = documents.join(gone, "file_id", "left_semi").select("document_id")
    return (
        files.join(gone, "file_id", "left_anti"),
        documents.join(gone, "file_id", "left_anti"),
        chunks.join(dropped, "document_id", "left_anti"),
    )


def orphan_documents(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents whose file is gone; a null file_id refers to none."""
    return documents.where(F.col("file_id").isNotNull()).join(files.select("file_id"), "file_id", "left_anti")


def upserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return stored.join(new.select(key), key, "left_anti").unionByName(new)
