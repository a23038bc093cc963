"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go when their query ends
_on_the_way: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)  # tables of the innermost ``settled``


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local master may go without it and gets a temporary folder."""
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="llm-scratch-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, readable after a lost executor.

    The tables lie under ``<shared>/llm-tables/<application id>/`` and live as long as frames read them; remove them
    with :func:`drop_tables`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-tables/{spark.sparkContext.applicationId}/{label}-{uuid4().hex}"
    if _on_the_way.get() is not None:
        _on_the_way.get().append(path)
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")  # the table is read from here on, so nothing needs the shuffles behind it
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``written(make(), label)``, after which the tables that ``make`` has written on the way are removed.

    Frames built inside that still read such a table must not be used later.
    """
    passing: list[str] = []
    token = _on_the_way.set(passing)
    try:
        made = make()
    finally:
        _on_the_way.reset(token)
    table = written(made, label)
    for path in passing:
        _remove(table.sparkSession, path)
    return table


def _remove(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_tables(spark: SparkSession) -> None:
    """Remove what :func:`written` has left for this application; frames built on it can't be read any more."""
    _remove(spark, f"{shared_dir(spark)}/llm-tables/{spark.sparkContext.applicationId}")
