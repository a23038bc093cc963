"""What a registered query is, and how results are presented."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    """A named report over the driver tables with the inventory ids it covers and its SQL counterpart."""

    name: str
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def presented(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text and decimals as doubles, as a service response shows them."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            col = col.cast("string")
        elif isinstance(field.dataType, T.TimestampType):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.DecimalType):
            col = col.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        out.append(col.alias(field.name))
    return df.select(*out)
