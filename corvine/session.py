"""Session helpers: the shared folder, shipping of this package, table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is missing (tests, a single local JVM) a temporary folder of this machine is taken.
    """
    conf = spark.sparkContext.getConf().get(_CHECKPOINT_KEY) or spark.conf.get(_CHECKPOINT_KEY, None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="corvine-shared-")
    spark.conf.set(_CHECKPOINT_KEY, made)
    return made


def prepare(spark: SparkSession) -> None:
    """Make checkpoints go to the shared folder and let executors import this package."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    if sc.master.startswith("local[") or sc.master == "local" or sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="corvine-ship-")) / "corvine_package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(at))  # the driver serves it; each executor, also a late one, fetches it
    _shipped.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str, keep: bool = True) -> str:
    """A fresh path in the shared folder; gone when the session's JVM ends unless kept."""
    at = f"{shared_dir(spark)}/corvine/{name}-{uuid.uuid4().hex}"
    if not keep:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)  # else there is nothing to be marked
        fs.deleteOnExit(path)
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there; gone when the session's JVM ends.

    It cuts the lineage like checkpoint(), which would run the plan twice.
    """
    spark = df.sparkSession
    at = scratch_path(spark, name)
    df.write.parquet(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def local_file(path: str) -> str | None:
    """The plain path behind a ``file:`` address or a bare path; None for other file systems."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
