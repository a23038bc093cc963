"""Calendar and bucket functions on dates and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_day_of_week(day: Column) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(day) + 1


def is_weekend(day: Column) -> Column:
    return iso_day_of_week(day).isin(6, 7)


def date_key(day: Column) -> Column:
    """Surrogate key of the date dimension, yyyymmdd as an integer.

    It is a pure function of the date, so a fact row gets its key without a lookup join and the key
    stays the same when the dimension is rebuilt.
    """
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def calendar_columns(day: Column) -> dict[str, Column]:
    """Model features of a calendar day."""
    dow = iso_day_of_week(day)
    dom = F.dayofmonth(day)
    return {
        "day_of_week": dow,
        "month": F.month(day),
        "quarter": F.quarter(day),
        "week_of_year": F.weekofyear(day),
        "is_weekend": dow.isin(6, 7).cast("int"),
        "day_of_month": dom,
        "is_month_start": (dom <= 3).cast("int"),
        "is_month_end": (dom >= 28).cast("int"),
    }


def time_bucket(ts: Column, bucket: str) -> Column:
    """Start of the UTC day or hour that holds ``ts``."""
    if bucket not in ("day", "hour"):
        raise ValueError("bucket must be 'day' or 'hour'")
    return F.date_trunc(bucket, ts)


def freshness_class(last_day: Column, today: Column) -> Column:
    """pass up to one day old, warn up to seven, else fail."""
    age = F.datediff(today, last_day)
    return F.when(age <= 1, "pass").when(age <= 7, "warn").otherwise("fail")
