"""Counter increase, histogram quantiles and sustained conditions over metric snapshots.

A snapshot series has one row per series and scrape time, so a series is bounded by time over interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counter_increase(snapshots: DataFrame, keys: list[str], ts: str, value: str, window_seconds: int) -> DataFrame:
    """Increase and rate of a counter over a trailing window, a drop counting as a restart from zero.

    Growth is summed along the series once; the increase is the difference between now and the first sample
    in the window, which is the smallest running sum there because growth is never negative.
    """
    series = W.partitionBy(*keys).orderBy("_sec")
    before = F.lag(value).over(series)
    growth = F.when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    running = F.sum("_growth").over(series.rowsBetween(W.unboundedPreceding, 0))
    window = series.rangeBetween(-window_seconds, 0)
    return (
        snapshots.withColumn("_sec", F.unix_seconds(F.col(ts)))
        .withColumn("_growth", growth)
        .withColumn("_running", running)
        .withColumn("increase", F.col("_running") - F.min("_running").over(window))
        .withColumn("rate", F.col("increase") / F.lit(float(window_seconds)))
        .drop("_sec", "_growth", "_running")
    )


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile of cumulative buckets (``le``, ``cumulative``) by linear interpolation.

    The bucket that first reaches the rank is interpolated from its lower bound (zero for the first); a rank in
    the infinite bucket gives the largest finite bound. Groups hold one row per bucket.
    """
    order = W.partitionBy(*keys).orderBy("le")
    whole = W.partitionBy(*keys)
    rows = buckets.withColumns(
        {
            "_below": F.coalesce(F.lag("cumulative").over(order), F.lit(0)),
            "_low": F.coalesce(F.lag("le").over(order), F.lit(0.0)),
            "_rank": F.max("cumulative").over(whole) * F.lit(float(q)),
        }
    ).where((F.col("_rank") > 0) & (F.col("cumulative") >= F.col("_rank")))
    inside = (F.col("_rank") - F.col("_below")) / (F.col("cumulative") - F.col("_below"))
    infinite = F.col("le") == float("inf")
    value = F.when(infinite, F.col("_low")).otherwise(F.col("_low") + (F.col("le") - F.col("_low")) * inside)
    return rows.groupBy(*keys).agg(F.min_by(value, "le").alias("quantile"))


def sustained(snapshots: DataFrame, keys: list[str], ts: str, condition: str, seconds: int) -> DataFrame:
    """State of a condition that must hold for a duration: inactive, pending, or firing once it has held."""
    series = W.partitionBy(*keys).orderBy(ts)
    holds = F.col(condition)
    island = F.sum(F.when(holds, 0).otherwise(1)).over(series.rowsBetween(W.unboundedPreceding, 0))
    rows = snapshots.withColumn("_island", island)
    since = F.min(F.when(holds, F.col(ts))).over(
        W.partitionBy(*keys, "_island").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    )
    rows = rows.withColumn("active_since", F.when(holds, since))
    held = F.unix_seconds(F.col(ts)) - F.unix_seconds("active_since")
    state = F.when(~holds, "inactive").when(held >= seconds, "firing").otherwise("pending")
    return rows.withColumn("state", state).drop("_island")


def heartbeat_age(ticks: DataFrame, keys: list[str], ts: str, now, stale_seconds: int = 180) -> DataFrame:
    """Seconds since the last tick of every key, and whether that is too long."""
    last = ticks.groupBy(*keys).agg(F.max(ts).alias("last_tick"))
    age = F.floor((F.unix_micros(F.lit(now)) - F.unix_micros("last_tick")) / 1000000)
    return last.withColumn("age_seconds", age.cast("long")).withColumn("is_stale", F.col("age_seconds") > stale_seconds)
