"""Labelled utterances from JSON documents ``{label: [text, ...]}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_intents(documents: DataFrame, column: str = "value") -> DataFrame:
    """(text, label) rows; texts are trimmed and blank ones dropped."""
    parsed = documents.select(F.explode(F.from_json(F.col(column), "map<string, array<string>>")).alias("label", "texts"))
    rows = parsed.select(F.explode("texts").alias("text"), "label")
    return rows.select(F.trim("text").alias("text"), "label").where("text <> ''")


def load_intents(spark: SparkSession, path: str) -> DataFrame:
    """Reads whole files, one JSON object each; an empty data set is refused."""
    rows = parse_intents(spark.read.text(path, wholetext=True))
    if rows.isEmpty():
        raise ValueError("Intents dataset is empty")
    return rows
