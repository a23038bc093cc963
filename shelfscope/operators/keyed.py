"""Latest-per-key and upsert, by aggregates instead of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` for every key.

    The greatest first order column by key is a hash aggregate over narrow rows, combined on the map side; the rows
    that have it are joined back, by broadcast where the keys are few, and only these few are ranked by the rest of
    the order. No table is sorted with all its columns, and a key that holds a third of all rows is no heavier than
    any other. The order columns must not be null and should end in a unique one.
    """
    top = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.max(order[0]).alias("_top"))
    same = F.col(order[0]) == F.col("_top")
    for k in keys:
        same = same & F.equal_null(F.col(k), F.col(f"_key_{k}"))
    newest = df.join(top, same).select(*[F.col(f"`{c}`") for c in df.columns])
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return newest.groupBy(*keys).agg(F.max_by(whole, rank).alias("newest")).select("newest.*")


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str, existing_unique: bool = False) -> DataFrame:
    """Rows of both frames, the incoming one where a key is in both, the highest version where it repeats.

    Existing rows are only looked up among the incoming keys, null keys included, and pass through as they are; only incoming
    rows are ranked. ``existing_unique`` says that no key repeats in ``existing``, as after an earlier upsert; otherwise its
    rows are ranked too. A column that one of the frames lacks is null in its rows.
    """
    kept = existing if existing_unique else latest_per_key(existing, keys, [version])
    arriving = incoming.select(*[F.col(k).alias(f"_key_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.equal_null(F.col(k), F.col(f"_key_{k}"))
    return kept.join(arriving, same, "left_anti").unionByName(latest_per_key(incoming, keys, [version]), allowMissingColumns=True)
