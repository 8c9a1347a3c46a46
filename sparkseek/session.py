"""Session construction and delivery of the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def build_session(app: str = "sparkseek", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is designed for; conf keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to every executor once per application.

    Python workers import operator modules by name, and an executor need not
    have the driver's working folder on its path.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        # Rows hold whole texts: smaller batches keep workers' and JVM buffers small.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="sparkseek-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "sparkseek_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(PACKAGE.rglob("*")):
            if path.is_file() and "__pycache__" not in path.parts:
                out.write(path, path.relative_to(PACKAGE.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, folder: str, name: str):
    """One input table; paths are only ever opened by Spark's readers."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def size_in_bytes(scan) -> int:
    """What Spark takes a table's scan to hold: the bytes of its files."""
    return int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(scan, per_core: int = 2):
    """Deal a plain table scan over the cores when its files give fewer splits than cores."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores * per_core)


def spread_by(scan, key: str, per_core: int = 2):
    """Hash a table over the cores by a key, so that later grouping by it (and more columns) needs no shuffle.

    The number is explicit: the few input bytes of a small table must not be coalesced into one task.
    """
    spark = scan.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism * per_core)
    return scan.repartition(n, key)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session gets one of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sparkseek-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store when the driver ends."""

    def attempt() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended already
            pass

    atexit.register(attempt)


def cut(df):
    """Materialise a frame reliably and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
