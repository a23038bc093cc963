"""Mergeable profiles: sketches of every day that are stored and merged at query time, beside the exact forms in ``kpi``.

Distinct counts are HyperLogLog sketches, quantiles KLL sketches, frequent values approximate top-k summaries, all Spark's own
aggregates: a day's row has bounded size whatever the day holds, partial sketches are combined before the shuffle, and a new day
reads that day only. Row, null and zero counts, minima and maxima are exact.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sketches:
    """Columns of each sketch and their sizes.

    ``lg``: 2**lg registers, a relative standard error of 1.04 / sqrt(2**lg) for distinct counts. ``k``: a quantile's rank is
    off by about 3.3 / k at most (99 of 100 times). ``tracked``: values followed a column; counts are exact while a column has no more of them.
    """

    distinct: tuple[str, ...] = ()
    quantiles: tuple[str, ...] = ()
    frequent: tuple[str, ...] = ()
    lg: int = 12
    k: int = 400
    tracked: int = 1000

    def columns(self) -> list[str]:
        return list(dict.fromkeys((*self.distinct, *self.quantiles, *self.frequent)))


def _hashable(rows: DataFrame, name: str) -> Column:
    """A column as HyperLogLog takes it: numbers of whole values as longs, all else as text."""
    column = F.col(name)
    return column.cast("long") if rows.schema[name].dataType.typeName() in ("byte", "short", "integer", "long") else column.cast("string")


def daily_profiles(rows: DataFrame, day: str, rule: Sketches) -> DataFrame:
    """A row a day: ``day``, row_count, and for each column its null count and the sketches that ``rule`` asks for.

    Nulls are in no sketch. A null day is a day of its own.
    """
    parts = [F.count("*").alias("row_count")]
    for c in rule.columns():
        parts.append(F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"))
    parts += [F.hll_sketch_agg(_hashable(rows, c), F.lit(rule.lg)).alias(f"{c}__hll") for c in rule.distinct]
    for c in rule.quantiles:
        value = F.col(c).cast("double")
        parts += [F.kll_sketch_agg_double(value, rule.k).alias(f"{c}__kll"), F.min(value).alias(f"{c}__min"), F.max(value).alias(f"{c}__max")]
        parts.append(F.count_if(value == 0).alias(f"{c}__zeros"))
    kept = rows.withColumns({f"{c}__text": F.col(c).cast("string") for c in rule.frequent})
    parts += [F.expr(f"approx_top_k_accumulate(`{c}__text`, {rule.tracked}) FILTER (WHERE `{c}` IS NOT NULL)").alias(f"{c}__top") for c in rule.frequent]
    return kept.groupBy(F.col(day).alias("day")).agg(*parts)


def _nothing(daily: DataFrame, rule: Sketches) -> DataFrame:
    """The profile of no rows, which changes no sum and no sketch; top-k summaries can't be combined from no row at all."""
    seed = daily.sparkSession.range(1).select(
        F.lit(None).cast(daily.schema["day"].dataType).alias("day"),
        *[F.lit(None).cast("double" if c in rule.quantiles else "string").alias(c) for c in rule.columns()],
    )
    counts = ["row_count", *[f"{c}__nulls" for c in rule.columns()]]
    profile = daily_profiles(seed.withColumnRenamed("day", "_day"), "_day", rule)
    return profile.withColumns({c: F.lit(0).cast("long") for c in counts})


def merged_profile(daily: DataFrame, rule: Sketches, ranks: tuple[float, ...] = (0.05, 0.5, 0.95), top: int = 10) -> DataFrame:
    """A row a column over all rows of ``daily``: column_name, row_count, null_count, distinct_estimate, quantiles (at ``ranks``), zero_count,
    min_value, max_value and frequent (value, num_rows), null for what the column has no sketch of.

    Filter ``daily`` on ``day`` for a window. Without any row all columns have no rows, a distinct estimate of 0 and no quantiles.
    """
    parts = [F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count")]
    for c in rule.columns():
        parts.append(F.coalesce(F.sum(f"{c}__nulls"), F.lit(0)).alias(f"{c}__nulls"))
    parts += [F.hll_sketch_estimate(F.hll_union_agg(f"{c}__hll")).alias(f"{c}__distinct") for c in rule.distinct]
    for c in rule.quantiles:
        parts += [F.kll_merge_agg_double(f"{c}__kll", rule.k).alias(f"{c}__kll"), F.sum(f"{c}__zeros").alias(f"{c}__zeros")]
        parts += [F.min(f"{c}__min").alias(f"{c}__min"), F.max(f"{c}__max").alias(f"{c}__max")]
    parts += [F.expr(f"approx_top_k_combine(`{c}__top`, {rule.tracked})").alias(f"{c}__top") for c in rule.frequent]
    merged = daily.unionByName(_nothing(daily, rule)).agg(*parts)

    def described(c: str) -> Column:
        ranked, counted = c in rule.quantiles, c in rule.frequent
        quantiles = F.when(F.col(f"{c}__max").isNotNull(), F.kll_sketch_get_quantile_double(f"{c}__kll", F.array(*map(F.lit, ranks)))) if ranked else F.lit(None)
        frequent = F.expr(f"approx_top_k_estimate(`{c}__top`, {top})") if counted else F.lit(None)
        numbers = {name: F.col(f"{c}__{name}") if ranked else F.lit(None) for name in ("zeros", "min", "max")}
        return F.struct(
            F.lit(c).alias("column_name"), "row_count", F.col(f"{c}__nulls").alias("null_count"),
            (F.col(f"{c}__distinct") if c in rule.distinct else F.lit(None).cast("long")).alias("distinct_estimate"),
            quantiles.cast("array<double>").alias("quantiles"), numbers["zeros"].cast("long").alias("zero_count"),
            numbers["min"].cast("double").alias("min_value"), numbers["max"].cast("double").alias("max_value"),
            frequent.cast("array<struct<value:string,num_rows:bigint>>").alias("frequent"),
        )

    return merged.select(F.inline(F.array(*[described(c) for c in rule.columns()])))


def store_profiles(rows: DataFrame, day: str, rule: Sketches, path: str, days: Iterable[date] | None = None) -> None:
    """Write the profiles of ``days`` (all of them without) to ``path``, a folder a day; the folders of other days stay.

    The filter on the day reaches the scan, so a new day reads that day only. A day that is written again replaces its folder.
    """
    wanted = rows if days is None else rows.where(F.col(day).isin(list(days)))
    profiles = daily_profiles(wanted, day, rule).repartition("day")
    profiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
