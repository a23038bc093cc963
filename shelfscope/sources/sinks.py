"""Writers: the warehouse, merges, reports, exports and metric snapshots."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from shelfscope.operators.keyed import latest_per_key, upserted

FACT_KEYS = ("store_id", "full_date")


def write_fact(fact: DataFrame, path: str) -> None:
    """Fact partitioned by year and month of the sales day.

    The rebalance hint lets adaptive execution split a large month over several tasks and join small ones, without
    the sampling pass of a range partitioning. Rows sorted by store inside a file let the reader skip row groups
    on a store filter.
    """
    dated = fact.withColumns({"year": F.year("full_date"), "month": F.month("full_date")})
    balanced = dated.hint("rebalance", F.col("year"), F.col("month"))
    balanced.sortWithinPartitions("year", "month", "store_id").write.mode("overwrite").partitionBy("year", "month").parquet(path)


def reload_warehouse(fact: DataFrame, dim_store: DataFrame, dim_date: DataFrame, root: str) -> None:
    """Full reload of the three tables as one step: they go to a folder of their own, and one appended line makes it the
    current one. A failure before that line leaves readers with the whole of the old version."""
    version = uuid4().hex
    folder = f"{root}/versions/{version}"
    dim_date.write.parquet(f"{folder}/dim_date")
    dim_store.write.parquet(f"{folder}/dim_store")
    write_fact(fact, f"{folder}/fact_sales_daily")
    _commit(fact.sparkSession, root, version)


def _commit(spark: SparkSession, root: str, version: str, merged: bool = False) -> None:
    made = spark.createDataFrame([(version, merged)], "version string, merged boolean").withColumn("made_at", F.current_timestamp())
    made.coalesce(1).write.mode("append").parquet(f"{root}/commits")


def _current(spark: SparkSession, root: str) -> tuple[str, bool]:
    """The newest version, and whether it refers to folders of earlier ones."""
    commits = spark.read.option("mergeSchema", True).parquet(f"{root}/commits")
    merged = F.col("merged") if "merged" in commits.columns else F.lit(False)
    version, refers = commits.agg(F.max_by(F.struct("version", F.coalesce(merged, F.lit(False))), "made_at")).first()[0]
    return version, refers


def current_folder(spark: SparkSession, root: str) -> str:
    return f"{root}/versions/{_current(spark, root)[0]}"


def warehouse_parts(spark: SparkSession, root: str) -> dict[tuple[str, int | None, int | None], str]:
    """Folder, below ``root``, of every part of the current version: (table, year, month), without a month for dimensions.

    One entry a month: bounded by the calendar."""
    version, refers = _current(spark, root)
    folder = f"versions/{version}"
    if refers:
        rows = spark.read.parquet(f"{root}/{folder}/parts").collect()
        return {(r["part"], r["year"], r["month"]): r["folder"] for r in rows}
    fact = f"{folder}/fact_sales_daily"
    months = _months(spark, f"{root}/{fact}")
    return {
        ("dim_store", None, None): f"{folder}/dim_store",
        ("dim_date", None, None): f"{folder}/dim_date",
        **{("fact_sales_daily", y, m): f"{fact}/year={y}/month={m}" for y, m in months},
    }


def _months(spark: SparkSession, fact: str) -> list[tuple[int, int]]:
    """Year and month folders; the values come from their names, no rows are read."""
    stored = spark.read.parquet(fact)
    return [] if "year" not in stored.columns else [tuple(r) for r in stored.select("year", "month").distinct().collect()]


def merge_fact(incoming: DataFrame, root: str, dim_store: DataFrame | None = None, dim_date: DataFrame | None = None) -> list[tuple[int, int]]:
    """Upsert fact rows, copying only the months that they fall in; returns these months.

    The new version holds the touched months and refers to the folders of earlier versions for all others, and for dimensions that
    aren't given anew. It becomes current by one appended line; a failure before that leaves the old version. ``incoming`` is
    computed once and kept beside the version; it needs one row a store and day, columns that it lacks are null, and columns
    that the fact lacks are refused.
    """
    spark = incoming.sparkSession
    parts = warehouse_parts(spark, root)
    version = uuid4().hex
    folder = f"versions/{version}"
    write_fact(incoming, f"{root}/{folder}/incoming")
    # The schema is given, since a folder of no rows has no file to take it from.
    arrived = spark.read.schema(StructType([*incoming.schema, StructField("year", IntegerType()), StructField("month", IntegerType())])).parquet(f"{root}/{folder}/incoming")
    months = sorted(tuple(r) for r in arrived.select("year", "month").distinct().collect())
    if not months:
        return []
    arrived = _fitted(arrived.drop("year", "month"), spark, [f"{root}/{where}" for (name, _, _), where in parts.items() if name == "fact_sales_daily"])
    if not arrived.groupBy(*FACT_KEYS).count().filter("count > 1").isEmpty():
        raise ValueError(f"incoming rows repeat a key of {FACT_KEYS}")
    touched = [f"{root}/{parts[key]}" for key in (("fact_sales_daily", y, m) for y, m in months) if key in parts]
    merged = upserted(spark.read.parquet(*touched), arrived, [*FACT_KEYS], "full_date", existing_unique=True) if touched else arrived
    write_fact(merged, f"{root}/{folder}/fact_sales_daily")
    parts |= {("fact_sales_daily", y, m): f"{folder}/fact_sales_daily/year={y}/month={m}" for y, m in months}
    for name, frame in (("dim_store", dim_store), ("dim_date", dim_date)):
        if frame is not None:
            frame.write.parquet(f"{root}/{folder}/{name}")
            parts[name, None, None] = f"{folder}/{name}"
    rows = [(*key, where) for key, where in parts.items()]
    spark.createDataFrame(rows, "part string, year int, month int, folder string").coalesce(1).write.parquet(f"{root}/{folder}/parts")
    _commit(spark, root, version, merged=True)
    return months


def _fitted(rows: DataFrame, spark: SparkSession, folders: list[str]) -> DataFrame:
    """``rows`` with the columns and types of the stored fact."""
    if not folders:
        return rows
    stored = spark.read.parquet(folders[0]).schema
    if unknown := sorted(set(rows.columns) - set(stored.names)):
        raise ValueError(f"columns that the fact lacks: {unknown}")
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in stored])


def read_fact(spark: SparkSession, root: str, date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    """Fact rows of a date range. A bound on the day says nothing about the year and month folders, so the same
    bound is put on these too and whole folders are left out."""
    version, refers = _current(spark, root)
    inside = lambda month: (
        (date_from is None or month >= date_from.year * 12 + date_from.month) and (date_to is None or month <= date_to.year * 12 + date_to.month)
    )
    if refers:
        parts = {key: where for key, where in warehouse_parts(spark, root).items() if key[0] == "fact_sales_daily"}
        chosen = [where for (_, y, m), where in parts.items() if inside(y * 12 + m)]
        # Without a month in the range an empty table of the right columns is what is left of any month.
        fact = spark.read.parquet(*[f"{root}/{where}" for where in chosen or list(parts.values())[:1]])
        fact = fact if chosen else fact.limit(0)
    else:
        fact = spark.read.parquet(f"{root}/versions/{version}/fact_sales_daily")
        folder = F.col("year") * 12 + F.col("month")
        if date_from is not None:
            fact = fact.where(folder >= date_from.year * 12 + date_from.month)
        if date_to is not None:
            fact = fact.where(folder <= date_to.year * 12 + date_to.month)
    if date_from is not None:
        fact = fact.where(F.col("full_date") >= F.lit(date_from))
    if date_to is not None:
        fact = fact.where(F.col("full_date") <= F.lit(date_to))
    return fact.drop("year", "month")


def read_warehouse(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    parts = warehouse_parts(spark, root)
    return {
        "fact_sales_daily": read_fact(spark, root),
        "dim_store": spark.read.parquet(f"{root}/{parts['dim_store', None, None]}"),
        "dim_date": spark.read.parquet(f"{root}/{parts['dim_date', None, None]}"),
    }


def merge_to(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str, path: str) -> DataFrame:
    """Upsert on keys, written to a new path: a table is never overwritten while it is read."""
    upserted(existing, incoming, keys, version).write.mode("errorifexists").parquet(path)
    return existing.sparkSession.read.parquet(path)


def append_log(records: DataFrame, path: str) -> None:
    """Run records are only ever appended; the newest per id is their state."""
    records.write.mode("append").parquet(path)


def record_batches(path: str, keys: list[str], version: str, stream: str = "records") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that upserts run records by id: :func:`newest_records` reads their state.

    Every micro-batch is a folder under the name of its stream and its number, which Spark keeps over restarts, and holds the newest
    record per key; ties are settled by a hash of the row. A batch that is delivered again replaces its own folder by the
    same rows, so it changes nothing. Streams with checkpoints of their own need names of their own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("_mark", F.xxhash64(*sorted(batch.columns)))
        newest = latest_per_key(marked, keys, [version, "_mark"]).drop("_mark")
        newest.write.mode("overwrite").parquet(f"{path}/stream={stream}/batch={batch_id}")

    return write


def newest_records(spark: SparkSession, path: str, keys: list[str], version: str) -> DataFrame:
    """The newest record per key of all batches: by version, then by stream and batch."""
    rows = spark.read.parquet(path)
    return latest_per_key(rows, keys, [version, "stream", "batch"]).drop("stream", "batch")


def write_unified_csv(df: DataFrame, path: str) -> None:
    """Every value quoted and quotes doubled, so that commas, quotes and line breaks come back as they were."""
    (
        df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd")
        .option("quoteAll", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def write_grid_csv(df: DataFrame, path: str) -> None:
    """Result grid with quoted commas, quotes and line breaks, null as empty."""
    (
        df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
        .option("nullValue", "").option("emptyValue", "").csv(path)
    )


def write_json_report(spark: SparkSession, report: dict[str, Any], path: str) -> None:
    text = json.dumps(report, ensure_ascii=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_report(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first()[0])


def write_exposition(lines: DataFrame, path: str) -> None:
    """Metric lines as text files, families in name order."""
    lines.orderBy("metric", "line").select("line").write.mode("overwrite").text(path)
