"""Processing only new or changed records.

State is a table of key, content hash and modification time. The current rows are hashed, joined with the state, and the
new or changed ones come out. A commit writes just what changed, as one more part, and then creates the next numbered
version file, which fails if another run created it first. A run that dies before that leaves the old version in force, so
its rows come out again; one that dies after it has committed them, so they don't.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.sources.snapshots import Pointer, mergeable


def newest_versions(rows: DataFrame, key: str = "file_path", version: str = "modified_at", hash_col: str = "content_hash", content: str | None = None) -> DataFrame:
    """One row per key: that with the greatest version.

    Where the hash is null and the rows hold their ``content``, it is hashed (SHA-256).

    Rows with a null key are no records and are left out; a null version is older than any other. Equal versions are
    settled by the greater hash, a null hash last, so repeated rows and ties give one defined row.
    """
    newest = F.max(F.struct(F.col(version).alias("v"), (F.lower(hash_col) if content is None else F.coalesce(F.lower(hash_col), F.sha2(content, 256))).alias("h")))  # a null field sorts lowest
    return (
        rows.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(newest.alias("n"))
        .select("key", F.col("n.v").alias("version"), F.col("n.h").alias("hash"))
    )


def committed_from_log(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Per path what its latest successful run committed, from a log of runs (``indexed_files``, ``sync_runs``).

    Paths lose a leading ``./`` and hashes their letter case. Rows of runs that aren't ``ok``, or unknown, don't count.
    """
    ok = runs.where(F.col("status") == "ok").select("run_id").distinct()
    newest = F.max(F.struct("run_id", F.col("modified_at").alias("v"), F.lower("content_hash").alias("h")))
    return (
        log.where(F.col("file_path").isNotNull())
        .select(F.regexp_replace("file_path", r"^(\./)+", "").alias("key"), "run_id", "modified_at", "content_hash")
        .join(ok, "run_id", "left_semi")
        .groupBy("key")
        .agg(newest.alias("n"))
        .select("key", F.col("n.v").alias("version"), F.col("n.h").alias("hash"))
    )


def _differs() -> Column:
    by_time = ~F.col("c.version").eqNullSafe(F.col("s.version"))
    by_hash = ~F.col("c.hash").eqNullSafe(F.col("s.hash"))
    return F.col("s.key").isNull() | F.when(F.col("c.hash").isNull(), by_time).otherwise(by_hash)


def changed(current: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of ``current`` (key, version, hash) that ``state`` (same columns) lacks or holds with other content.

    Where the current hash is null the versions decide. Keys that only the state has don't come out.
    """
    return (
        current.alias("c")
        .join(state.alias("s"), F.col("c.key") == F.col("s.key"), "left")
        .where(_differs())
        .select("c.key", "c.version", "c.hash", F.col("s.key").isNull().alias("is_new"))
    )


class StateStore:
    """Versions of the state in ``root``: parts of rows, and numbered files in ``versions`` that list the parts in force.

    Of several rows of a key that of the latest commit counts; ``gone`` says that it took the key away. Parts are merged by
    tiers of their size, as in ``Snapshots``, so a small commit writes little whatever the state's size.
    """

    SCHEMA = "key string, version long, hash string"
    FAN = 8

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._versions = Pointer(spark, f"{self.root}/versions")

    def pointer(self) -> dict | None:
        return self._versions.read()

    def _newest(self, parts: list[list]) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA + ", at long, gone boolean").parquet(*[f"{self.root}/{p}" for p, _ in parts])
        if len(parts) == 1:
            return rows  # has a key once
        newest = F.max_by(F.struct("version", "hash", "at", "gone"), "at")
        return rows.groupBy("key").agg(newest.alias("n")).select("key", "n.*")

    def state(self) -> DataFrame:
        now = self.pointer()
        return self._newest(now["parts"]).where("NOT gone").select("key", "version", "hash") if now else self.spark.createDataFrame([], self.SCHEMA)

    def changes(self, current: DataFrame) -> DataFrame:
        return changed(current, self.state())

    def commit(self, processed: DataFrame, gone: DataFrame | None = None) -> int:
        """Put ``processed`` (key, version, hash) in the state and drop the keys of ``gone``; the new version's number.

        Another commit since this one began makes it fail with a RuntimeError, so that no run's rows get lost. Keys are
        taken once; one that is in both is kept.
        """
        before = self.pointer() or {"version": 0, "parts": []}
        n = before["version"] + 1
        rows = processed.select("key", "version", "hash", F.lit(False).alias("gone"))
        if gone is not None:
            rows = rows.unionByName(gone.select("key", F.lit(None).cast("long").alias("version"), F.lit(None).cast("string").alias("hash"), F.lit(True).alias("gone")))
        one = F.max(F.struct((~F.col("gone")).alias("kept"), "version", "hash", "gone"))
        delta = rows.groupBy("key").agg(one.alias("n")).select("key", "n.version", "n.hash", F.lit(n).cast("long").alias("at"), "n.gone")
        parts = [*before["parts"], self._write(delta, n)]
        if small := mergeable([r for _, r in parts], self.FAN):
            merged = self._newest(parts[-small:])
            parts[-small:] = [self._write(merged if small < len(parts) else merged.where("NOT gone"), n)]
        self._swap({"version": n, "parts": parts})
        return n

    def _write(self, rows: DataFrame, n: int) -> list:
        name = f"v-{n}-{uuid.uuid4().hex}"
        rows.select("key", "version", "hash", "at", "gone").write.parquet(f"{self.root}/{name}")
        return [name, self.spark.read.parquet(f"{self.root}/{name}").count()]  # from the footers

    def _swap(self, pointer: dict) -> None:
        self._versions.create(pointer)
