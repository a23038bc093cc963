"""Coercion of raw text columns to contract types; bad values become null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRUE_WORDS = ("1", "true", "t", "yes", "y")
FALSE_WORDS = ("0", "false", "f", "no", "n")

# Date notations read by contracts, told apart by their shape.
ISO_DAY = r"^\d{4}-\d{1,2}-\d{1,2}$"
ISO_MOMENT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?$"
SLASH_YEAR_FIRST = r"^\d{4}/\d{2}/\d{2}$"
SLASH_MONTH_FIRST = r"^\d{2}/\d{2}/\d{4}$"
COMPACT_DAY = r"^\d{8}$"
NAMED_MONTH = r"^\d{2}-[A-Za-z]{3}-\d{4}$"
ISO_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
)

SPARK_TYPES = {
    "string": "string",
    "int": "bigint",
    "float": "double",
    "date": "date",
    "bool": "boolean",
}


def _text(value: Column) -> Column:
    return F.trim(value.cast("string"))


def to_number(value: Column) -> Column:
    number = _text(value).try_cast("double")
    # The words NaN and Infinity parse as doubles but hold no usable number.
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def to_int(value: Column) -> Column:
    """Whole numbers are read exactly; other notations go through double, so '5.0' is 5 and a fraction is cut off."""
    text = _text(value)
    return F.when(text.rlike(r"^[+-]?\d{1,19}$"), text.try_cast("bigint")).otherwise(to_number(value).try_cast("bigint"))


def to_timestamp_mixed(value: Column) -> Column:
    """Timestamp from any of the declared notations.

    The notation is recognised by shape and rewritten to ISO text, which a cast reads without formatters;
    trying one format after the other would raise and catch an exception per miss.
    """
    text = _text(value)

    def iso(year: int, month: int, day: int) -> Column:
        return F.concat_ws("-", F.substring(text, year, 4), F.substring(text, month, 2), F.substring(text, day, 2))

    rewritten = (
        F.when(F.rlike(text, F.lit(ISO_DAY)) | F.rlike(text, F.lit(ISO_MOMENT)), text)
        .when(F.rlike(text, F.lit(SLASH_YEAR_FIRST)), iso(1, 6, 9))
        .when(F.rlike(text, F.lit(SLASH_MONTH_FIRST)), iso(7, 1, 4))
        .when(F.rlike(text, F.lit(COMPACT_DAY)), iso(1, 5, 7))
    )
    named = F.when(F.rlike(text, F.lit(NAMED_MONTH)), F.try_to_timestamp(F.initcap(text), F.lit("dd-MMM-yyyy")))
    return F.coalesce(rewritten.try_cast("timestamp"), named)


def to_day(value: Column) -> Column:
    return to_timestamp_mixed(value).cast("date")


def to_bool(value: Column) -> Column:
    word = F.lower(_text(value))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def to_utc_timestamp(value: Column) -> Column:
    """ISO-8601 text, with or without a zone; no zone means UTC."""
    text = F.trim(value.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for fmt in ISO_FORMATS])


def truthy(value: Column) -> Column:
    """True for true, non-zero numbers and the true words; everything else, null too, is false."""
    word = F.lower(_text(value))
    number = to_number(value)
    return F.coalesce(word.isin(*TRUE_WORDS) | (number != 0), F.lit(False))


COERCIONS = {
    "string": lambda value: _text(value),
    "int": to_int,
    "float": to_number,
    "date": to_day,
    "bool": to_bool,
}


def coerce(value: Column, dtype: str) -> Column:
    return COERCIONS[dtype](value)


def is_invalid(value: Column, dtype: str) -> Column:
    """Present but not readable as ``dtype``. Text always reads."""
    if dtype == "string":
        return F.lit(False)
    return value.isNotNull() & coerce(value, dtype).isNull()
