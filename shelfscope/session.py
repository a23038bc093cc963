"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Instants everywhere: UTC, and Parquet timestamps without zone read as UTC instants. Fields of one JSON report are
# taken from one parse; the optimizer's rewrite to a pruned parse per field costs more when several are used.
QUERY_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.optimizer.enableJsonExpressionOptimization": "false",
}
# Tasks of the table queries are sized by their input, not by the cluster's number of partitions: a compressed row of a few
# numbers takes ten to twenty times its size in hash maps. Over 200 partitions a map task would keep its rows to sort them.
SIZED_CONF = {
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def size_partitions(spark: SparkSession, wanted: bool) -> None:
    """Set ``SIZED_CONF``, or take it back where it isn't wanted. What the session has set itself stays."""
    if wanted and not hasattr(spark, "_shelfscope_sized"):
        spark._shelfscope_sized = [key for key in SIZED_CONF if spark.conf.get(key, None) is None]
        for key in spark._shelfscope_sized:
            spark.conf.set(key, SIZED_CONF[key])
    elif not wanted and hasattr(spark, "_shelfscope_sized"):
        for key in spark._shelfscope_sized:
            spark.conf.unset(key)
        del spark._shelfscope_sized


def build_session(app_name: str = "shelfscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every query here relies on: UTC and adaptive execution.

    Shuffle parallelism is left to the cluster's own setting plus AQE coalescing; local callers
    (tests, bench) pass ``spark.sql.shuffle.partitions`` themselves.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in {**QUERY_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that Python tasks find it from any working folder.

    Not needed where it is installed on them, given with ``--py-files``, or on their ``PYTHONPATH``.
    """
    package = Path(__file__).resolve().parent
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark, "_shelfscope_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="shelfscope-")) / "shelfscope_package.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted(package.rglob("*.py")):
            packed.write(file, str(file.relative_to(package.parent)))
    spark.sparkContext.addPyFile(str(archive))
    spark._shelfscope_shipped = True


def _shared_folder(df: DataFrame) -> str | None:
    return df.sparkSession.sparkContext.getCheckpointDir() or df.sparkSession.conf.get(CHECKPOINT_CONF, None)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the cluster's shared folder.

    The folder is the one named by ``spark.checkpoint.dir``. A session without that setting and without
    a checkpoint directory of its own is refused: a machine-local folder would not survive an executor.
    """
    folder = _shared_folder(df)
    if not folder:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """A small aggregate that the same plan reads more than once.

    Written to the shared folder where there is one, so that the large input behind it is read once; without
    such a folder it stays lazy and is computed per use.
    """
    return checkpointed(df) if _shared_folder(df) else df


@contextmanager
def reused(df: DataFrame) -> Iterator[DataFrame]:
    """A frame that many jobs read.

    On a cluster with a shared checkpoint folder it is written there once, so a lost executor costs no
    recomputation; elsewhere it is cached and computed again where a cached part is lost.
    """
    if _shared_folder(df):
        yield checkpointed(df)
        return
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield cached
    finally:
        cached.unpersist()
