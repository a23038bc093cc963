"""Contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.scratch import written


def balanced_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shard and place in it: rows in order of id, cut where the running bytes pass equal targets.

    Only (id, size, checksum) moves. Rows are dealt by ranges of the id, each part is summed, the parts' totals (one
    row a part) become offsets, and a running sum inside a part gives the global prefix. A row goes to the shard in
    whose target its middle byte falls, so a cut is off by half a row at most.

    Defined cases: a null or empty text has size 1 and checksum 0; null ids come first; rows with equal ids are
    ordered by size and checksum, equal rows are interchangeable and a repeated id is split like any other range; an
    empty table gives no rows; further columns of ``docs`` are ignored. Fewer rows than shards leave shards empty.
    """
    text = F.col(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["doc_id", "size", "text_crc32", "tie"]
    parts = written(sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-parts")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    middle = 2 * (F.col("bytes_before") + F.sum("size").over(inside)) - F.col("size")
    numbered = (
        parts.join(F.broadcast(offsets), "part")  # one row a shuffle partition
        .withColumn("middle", middle)
        .withColumn("place", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"cast((middle * {n_shards}) div (2 * all_bytes) as int)"))
    )
    firsts = numbered.groupBy("shard").agg(F.min("place").alias("first_place"))
    return numbered.join(F.broadcast(firsts), "shard").select(  # one row a shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first_place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
