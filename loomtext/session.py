"""Session and table access."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "loomtext", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC, and any further settings (underscores stand for dots)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


_ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()
_one_ships = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once for each application.

    Needed where it is neither installed nor on PYTHONPATH. Spark's file server hands the archive to every
    executor, those that join later too; the folder it is packed in is only read by the driver.
    """
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or "site-packages" in _ROOT.parts:
        return
    app = spark.sparkContext.applicationId
    with _one_ships:
        if app not in _shipped:
            folder = tempfile.mkdtemp(prefix="loomtext-")
            spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/loomtext", "zip", _ROOT, "loomtext"))
            _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory; the path is left to Spark, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the folder in spark.checkpoint.dir, which the driver and all executors share, and go on from there.

    Only where that setting is absent and all tasks run in the driver's process (a local master) a temporary folder is made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomtext-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over twice as many partitions as there are cores, where it is so small that its files have few.

    A file is cut by size, but a row group goes to one task whole, so a small file of one row group would be read and worked on
    by a single core. Inputs of four partitions a core and more are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < 4 * cores else df


def small_batches(spark: SparkSession, rows: int) -> None:
    """From now on batches that go to Python workers have at most so many rows, or fewer if that is set.

    The setting is read when a query starts, and it changes no result. Left at 10000 rows, a batch of documents takes some 100 MB on either
    side of each worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)
