"""Versioned tables: rows are written beside the old ones, and a commit creates the next numbered version file."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from corvine.session import local_file


class Pointer:
    """Small JSON files on any Hadoop file system, numbered from 1, of which the greatest is in force.

    A version is written aside and moved to its name only if no file has that name: a hard link on a local file system, a
    rename that doesn't overwrite elsewhere. Of several runs that commit the same version one succeeds, whenever they look.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(path).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _versions(self) -> list[int]:
        at = self._at(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _file(self, version: int) -> str:
        return f"{self.path}/{version:020}.json"

    def read(self) -> dict | None:
        versions = self._versions()
        if not versions:
            return None
        stream = self._fs.open(self._at(self._file(versions[-1])))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, value: dict) -> None:
        """Put ``value`` in force as the version it names; RuntimeError if another run did so first."""
        data, name = json.dumps(value).encode(), f"{self.path}/{uuid.uuid4().hex}.tmp"
        if here := local_file(self.path):
            os.makedirs(here, exist_ok=True)
            aside = local_file(name)
            with open(aside, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(aside, local_file(self._file(value["version"])))
            except FileExistsError:
                raise RuntimeError("another run committed meanwhile") from None
            finally:
                os.unlink(aside)
            return
        self._fs.mkdirs(self._at(self.path))
        out = self._fs.create(self._at(name), True)
        out.write(bytearray(data))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.path).toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._at(name), self._at(self._file(value["version"])), options)
        except Exception as e:
            self._fs.delete(self._at(name), False)
            if self._fs.exists(self._at(self._file(value["version"]))):
                raise RuntimeError("another run committed meanwhile") from e
            raise

    def forget(self) -> None:
        """Remove the files of versions that are no longer in force."""
        for version in self._versions()[:-1]:
            self._fs.delete(self._at(self._file(version)), False)

    def remove(self, path: str) -> None:
        self._fs.delete(self._at(path), True)


def mergeable(rows: list[int], fan: int) -> int:
    """How many parts at the end of a list should be made one: those up to the ``fan``-th of one tier, none of a higher tier among them.

    A tier holds sizes that differ eightfold at most; a large part stays as it is until there are ``fan`` of its tier.
    """
    tiers = [max(r, 1).bit_length() // 3 for r in rows]
    for tier in sorted(set(tiers)):
        n = 0
        while n < len(tiers) and tiers[-1 - n] <= tier:
            n += 1
        if tiers[len(tiers) - n :].count(tier) >= fan:
            return n
    return 0


class Snapshots:
    """Several tables under one pointer, so that a commit shows all of its changes at once or none.

    A table is a list of parts, which only grows by what a commit adds, and a list of keys that are gone; neither is ever
    rewritten by a commit, so a small change of a large table costs little. Keys aren't used again, so a key that is gone
    is gone from all parts. Parts are of tiers by their number of rows; once ``FAN`` parts of a tier or below end a list,
    the commit makes one part of them, so a row is rewritten only as often as the list's size grows ``FAN``-fold. What no
    pointer names any more is removed by ``vacuum``.
    """

    FAN = 8

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, str]):
        """``keys`` names the column by which rows of a table go."""
        self.spark, self.root, self.schemas, self.keys = spark, root.rstrip("/"), schemas, keys
        self.pointer = Pointer(spark, f"{self.root}/CURRENT")

    def _now(self) -> dict:
        return self.pointer.read() or {"version": 0, "tables": {}, "next_id": {}}

    def version(self) -> int:
        return self._now()["version"]

    def read(self, name: str) -> DataFrame:
        """The table as committed; without rows if it never was."""
        return self._read(name, self._now()["tables"].get(name, {"parts": [], "gone": []}))

    def _read(self, name: str, lists: dict) -> DataFrame:
        if not lists["parts"]:
            return self.spark.createDataFrame([], self.schemas[name])
        rows = self._rows(name, lists["parts"], self.schemas[name])
        if not lists["gone"]:
            return rows
        gone = self._rows(name, lists["gone"], f"{self.keys[name]} long")
        return rows.join(gone, self.keys[name], "left_anti").select(*rows.columns)

    def _rows(self, name: str, parts: list[list], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p, _ in parts])

    def next_id(self, name: str) -> int:
        """The first id that was never given out: ids aren't used again, also after deletions."""
        return self._now()["next_id"].get(name, 1)

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None, next_ids: dict[str, int] | None = None) -> int:
        """Put tables in place of what there is, add rows to tables, and let keys go (one column each); all or nothing."""
        before = self._now()
        n = before["version"] + 1
        tables = {name: {k: list(v) for k, v in lists.items()} for name, lists in before["tables"].items()}

        def write(df: DataFrame, name: str, kind: str) -> list:
            at = f"{name}/{kind}-v{n}-{uuid.uuid4().hex[:12]}"
            df.write.parquet(f"{self.root}/{at}")
            return [at, self.spark.read.parquet(f"{self.root}/{at}").count()]  # from the footers

        for name, df in (replace or {}).items():
            tables[name] = {"parts": [write(df, name, "part")], "gone": []}
        for kind, changes in (("gone", gone), ("parts", append)):
            for name, df in (changes or {}).items():
                lists = tables.setdefault(name, {"parts": [], "gone": []})
                lists[kind].append(write(df, name, kind.removesuffix("s")))
        for name in {*(append or {}), *(gone or {})}:
            lists = tables[name]
            for kind, schema in (("parts", self.schemas[name]), ("gone", f"{self.keys[name]} long")):
                if small := mergeable([rows for _, rows in lists[kind]], self.FAN):
                    if kind == "parts" and small == len(lists[kind]):  # all of the table, so nothing need be known as gone
                        tables[name] = lists = {"parts": [write(self._read(name, lists), name, "part")], "gone": []}
                        break
                    lists[kind][-small:] = [write(self._rows(name, lists[kind][-small:], schema), name, kind.removesuffix("s"))]
        self.pointer.create({"version": n, "tables": tables, "next_id": before["next_id"] | (next_ids or {})})
        return n

    def vacuum(self) -> None:
        """Remove what no pointer names; not while others still read an old version."""
        self.pointer.forget()
        kept = {p for lists in self._now()["tables"].values() for own in lists.values() for p, _ in own}
        fs = self.pointer._fs
        for name in self.schemas:
            at = self.pointer._at(f"{self.root}/{name}")
            if fs.exists(at):
                for status in fs.listStatus(at):
                    if f"{name}/{status.getPath().getName()}" not in kept:
                        self.pointer.remove(status.getPath().toString())
