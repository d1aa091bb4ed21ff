"""File trees as a data source: ``spark.read.format("corvine_files")``.

Unlike the built-in binary source it also lists names with a leading dot or underscore. The driver walks the tree, leaves
excluded folders out and doesn't enter folders outside of the include patterns; executors read the files, in partitions of
about equal bytes. Options: ``path``, ``files``, ``include``, ``exclude`` (JSON lists), ``content`` (true or false),
``listing`` (true: no file is opened, so there are neither hash nor content), ``partition_bytes``.

What can't be listed or read (a folder without rights, a link to nothing, a file that is gone since the walk) is a row with
``error`` and no size, time, hash or content.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvine.functions.globs import FileFilter, include_folders, to_regex

SCHEMA = "file_path string, filename string, size bigint, modified_at bigint, content_hash string, content string, error string"


def _java_to_python(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)


def _rule(patterns: list[str]) -> re.Pattern:
    return re.compile("|".join(f"(?:{_java_to_python(to_regex(p))})" for p in patterns) or r"(?!)")


class Walk:
    """The files of a tree that a filter takes, in the order of their names; each once."""

    def __init__(self, root: str, rules: FileFilter):
        self.root, self.rules = root, rules
        self.include, self.exclude = _rule(rules.include), _rule(rules.exclude)
        self.folders = include_folders(rules.include)

    def _entered(self, folder: str) -> bool:
        if self.exclude.search(folder):
            return False
        return not self.folders or any(folder == f or folder.startswith(f + "/") or f.startswith(folder + "/") for f in self.folders)

    def _taken(self, path: str) -> bool:
        if self.rules.files:
            return path in self.rules.files or path.rsplit("/", 1)[-1] in self.rules.files or bool(self.include.search(path))
        return bool(self.include.search(path)) and not self.exclude.search(path)

    def paths(self) -> Iterator[str]:
        seen: set[str] = set()
        self.errors: list[tuple[str, str]] = []
        if self.rules.include:
            for folder, folders, names in os.walk(self.root, onerror=lambda e: self.errors.append((os.path.relpath(e.filename, self.root), str(e)))):
                inner = os.path.relpath(folder, self.root).replace(os.sep, "/")
                inner = "" if inner == "." else inner + "/"
                folders[:] = sorted(d for d in folders if self._entered(inner + d))
                for name in sorted(names):
                    path = inner + name
                    outside = self.folders and not any(path.startswith(f + "/") for f in self.folders)
                    if not outside and self._taken(path):
                        seen.add(path)
                        yield path
        for name in self.rules.files:  # named files, as they stand below the root
            path = name.removeprefix("./")
            if path not in seen and os.path.isfile(os.path.join(self.root, path)):
                seen.add(path)
                yield path


class _Files(InputPartition):
    def __init__(self, files: list[tuple]):
        self.files = files  # rows as they are known from the walk


def read_file(root: str, path: str, content: bool = True) -> tuple:
    """The row of one file, opened and hashed; a row with an error where that fails."""
    full, name = os.path.join(root, path), path.rsplit("/", 1)[-1]
    try:
        status = os.stat(full)
        with open(full, "rb") as f:
            data = f.read()
    except OSError as e:
        return path, name, None, None, None, None, str(e)
    return path, name, status.st_size, int(status.st_mtime), hashlib.sha256(data).hexdigest(), data.decode("utf-8", "replace") if content else None, None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path") or "."
        self.content = str(options.get("content", "true")).lower() == "true"
        self.listing = str(options.get("listing", "false")).lower() == "true"
        self.bytes = int(options.get("partition_bytes", 32 << 20))
        self.rules = FileFilter(*(json.loads(options.get(k) or "[]") for k in ("files", "include", "exclude")))

    def partitions(self) -> list[_Files]:
        out, own, size = [], [], 0
        walk = Walk(self.root, self.rules)
        for path in walk.paths():
            name = path.rsplit("/", 1)[-1]
            try:
                status = os.stat(os.path.join(self.root, path))
            except OSError as e:
                own.append((path, name, None, None, None, None, str(e)))
                continue
            own.append((path, name, status.st_size, int(status.st_mtime), None, None, None))
            size += status.st_size
            if size >= self.bytes:
                out.append(_Files(own))
                own, size = [], 0
        own += [(path, path.rsplit("/", 1)[-1], None, None, None, None, error) for path, error in walk.errors]
        return [*out, _Files(own)] if own or not out else out

    def read(self, partition: _Files) -> Iterator[tuple]:
        for row in partition.files:
            yield row if self.listing or row[-1] is not None else read_file(self.root, row[0], self.content)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corvine_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str, rules: FileFilter | None = None, content: bool = True, prefix: str = "", listing: bool = False, errors: bool = False) -> DataFrame:
    """The files of a tree; paths get ``prefix`` in front of them. Rows with an ``error`` come out only if asked for."""
    spark.dataSource.register(FileTree)
    rules = rules or FileFilter()
    options = {"path": root, "files": json.dumps(rules.files), "include": json.dumps(rules.include), "exclude": json.dumps(rules.exclude), "content": str(content).lower(), "listing": str(listing).lower()}
    rows = spark.read.format("corvine_files").options(**options).load()
    rows = rows if errors else rows.where("error IS NULL").drop("error")
    return rows.withColumn("file_path", F.concat(F.lit(prefix), F.col("file_path"))) if prefix else rows


def read_listed(listed: DataFrame, root: str, prefix: str = "") -> DataFrame:
    """The files of ``listed`` (file_path with ``prefix``), opened and hashed on executors; with ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():  # one at a time, as a file may be large
                row = read_file(root, path[len(prefix) :])
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, *row[1:]), kinds)], names=["file_path", "filename", "size", "modified_at", "content_hash", "content", "error"])

    return listed.select("file_path").mapInArrow(run, SCHEMA)
