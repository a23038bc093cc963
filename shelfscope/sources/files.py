"""CSV inputs: file checks, encoding choice and text scans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings in the order they are tried (contract name -> Java name), and words read as missing.
ENCODINGS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "cp1251": "windows-1251"}
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass(frozen=True)
class FileFacts:
    path: str
    exists: bool
    size_bytes: int = 0

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1]

    @property
    def is_csv(self) -> bool:
        return self.name.lower().endswith(".csv")


def file_facts(spark: SparkSession, path: str) -> FileFacts:
    """Existence and total size from file metadata; no content is read."""
    try:
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    except AnalysisException:
        return FileFacts(path, False)
    return FileFacts(path, True, int(size or 0))


def choose_encoding(spark: SparkSession, path: str, encodings: list[str] | None = None) -> str:
    """First encoding in which the file reads.

    Text rows carry the raw bytes, so one distributed scan tells whether all of them are UTF-8; the single-byte
    encoding reads anything.
    """
    wanted = encodings or list(ENCODINGS)
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count() > 0
    for name in wanted:
        if ENCODINGS[name] != "UTF-8" or not broken:
            return name
    raise ValueError(f"CSV parsing failed for {path}. Tried encodings {wanted}")


def read_raw_csv(spark: SparkSession, path: str, encoding: str = "utf-8", multiline: bool = False) -> DataFrame:
    """Every column as text, missing words as null, a byte-order mark taken off the first header.

    ``multiline`` reads line breaks inside quotes; a file is then read by one task, so it is the contract's choice.
    """
    if ENCODINGS[encoding] != "UTF-8":
        # Spark 4 admits single-byte code pages in CSV only with this setting.
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = (
        spark.read.option("header", True)
        .option("encoding", ENCODINGS[encoding])
        .option("multiLine", multiline)
        .option("escape", '"')
        .csv(path)
    )
    return missing_as_null(df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns}))


def missing_as_null(df: DataFrame) -> DataFrame:
    """Text columns with the words for a missing value as null."""
    return df.select(
        *[F.when(~F.coalesce(F.col(f"`{c}`"), F.lit("")).isin(*MISSING_WORDS), F.col(f"`{c}`")).alias(c) for c in df.columns]
    )


def csv_lines(df: DataFrame) -> DataFrame:
    """(line): every row as a CSV line, quoted where needed, spaces kept."""
    text = F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    keep = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return df.select(F.to_csv(text, keep).alias("line"))


def parsed_lines(lines: DataFrame, names: list[str], column: str = "line") -> DataFrame:
    """CSV lines that come as rows (of a queue, or a text column) as :func:`read_raw_csv` gives them: text, missing words as null.

    A line with fewer fields has nulls for the others; a null line gives a row of nulls.
    """
    schema = ", ".join(f"`{name}` string" for name in names)
    # As a generator the parsed row is computed once, not once in every expression on its fields.
    return missing_as_null(lines.select(F.inline(F.array(F.from_csv(column, schema, {"escape": '"'})))))


def load_raw_data(
    spark: SparkSession, sales_path: str, store_path: str, multiline: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Both inputs, raw CSV or unified Parquet; a missing one is an error."""
    for path in (sales_path, store_path):
        if not file_facts(spark, path).exists:
            raise FileNotFoundError(f"input not found: {path}")

    def read(path: str) -> DataFrame:
        if path.endswith(".parquet"):
            return spark.read.parquet(path)
        return read_raw_csv(spark, path, choose_encoding(spark, path), multiline)

    return read(sales_path), read(store_path)


def smoke_data(spark: SparkSession, stores: int = 10, days: int = 500, start: str = "2013-01-01") -> tuple[DataFrame, DataFrame]:
    """Deterministic demo input in the raw headers: closed Sundays, sales from 3000 to 12000."""
    key = F.col("id") + 1

    def draw(salt: int, low: int, high: int):
        return F.lit(low) + F.pmod(F.xxhash64("Store", "Date", F.lit(salt)), F.lit(high - low + 1))

    base = spark.range(stores).select(
        key.alias("Store"),
        F.explode(F.sequence(F.to_date(F.lit(start)), F.date_add(F.to_date(F.lit(start)), days - 1))).alias("Date"),
    )
    closed = F.weekday("Date") == 6
    sales = base.select(
        "Store",
        (F.weekday("Date") + 1).alias("DayOfWeek"),
        "Date",
        F.when(closed, 0).otherwise(draw(1, 3000, 12000)).alias("Sales"),
        F.when(closed, 0).otherwise(draw(2, 300, 1200)).alias("Customers"),
        F.when(closed, 0).otherwise(1).alias("Open"),
        draw(3, 0, 1).alias("Promo"),
        F.lit("0").alias("StateHoliday"),
        draw(4, 0, 1).alias("SchoolHoliday"),
    )
    attributes = spark.range(stores).select(
        key.alias("Store"),
        F.substring(F.lit("abcd"), (F.col("id") % 4 + 1).cast("int"), F.lit(1)).alias("StoreType"),
        F.substring(F.lit("abc"), (F.col("id") % 3 + 1).cast("int"), F.lit(1)).alias("Assortment"),
        (F.pmod(F.xxhash64("id"), F.lit(20000)) + 100).alias("CompetitionDistance"),
        F.lit(None).cast("int").alias("CompetitionOpenSinceMonth"),
        F.lit(None).cast("int").alias("CompetitionOpenSinceYear"),
        (F.col("id") % 2).alias("Promo2"),
        F.lit(None).cast("int").alias("Promo2SinceWeek"),
        F.lit(None).cast("int").alias("Promo2SinceYear"),
        F.when(F.col("id") % 2 == 1, "Jan,Apr,Jul,Oct").alias("PromoInterval"),
    )
    return sales, attributes
