"""Semantic quality rules compiled to Spark.

All column rules and row-count rules of a profile become one aggregate; each uniqueness rule adds one grouped
count. Rule types are a registry: name -> builder of counters and of the violation test.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.functions.coerce import to_number
from shelfscope.sources.contracts import Rule, normal_name

SAMPLE_SIZE = 5
RESULT_COLUMNS = "rule_id rule_type target severity status violations observed message".split()


@dataclass
class Compiled:
    """Counters to aggregate, and over their results: violation flag, number of violations, observed values."""

    counters: dict[str, Column]
    violated: Column
    violations: Column
    observed: dict[str, Column]


def _between(df: DataFrame, rule: Rule, tag: str) -> Compiled:
    number = to_number(F.col(rule.column))
    outside = F.lit(False)
    if rule.min_value is not None:
        outside = outside | (number < rule.min_value)
    if rule.max_value is not None:
        outside = outside | (number > rule.max_value)
    unknown, out = F.col(f"{tag}_null"), F.col(f"{tag}_out")
    return Compiled(
        {
            f"{tag}_null": F.count_if(number.isNull()),
            f"{tag}_out": F.count_if(outside),
            f"{tag}_min": F.min(number),
            f"{tag}_max": F.max(number),
        },
        unknown + out > 0,
        unknown + out,
        {
            "null_or_invalid_count": unknown,
            "out_of_range_count": out,
            "min_observed": F.col(f"{tag}_min"),
            "max_observed": F.col(f"{tag}_max"),
        },
    )


def _accepted(df: DataFrame, rule: Rule) -> Column:
    """True where the value is one of the accepted ones; numbers match numbers, text matches text."""
    numeric = isinstance(df.schema[rule.column].dataType, T.NumericType)
    numbers = [float(v) for v in rule.values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    words = [v for v in rule.values if isinstance(v, str)]
    if numeric:
        return F.col(rule.column).cast("double").isin(numbers) if numbers else F.lit(False)
    return F.col(rule.column).isin(words) if words else F.lit(False)


def _accepted_values(df: DataFrame, rule: Rule, tag: str) -> Compiled:
    invalid = F.col(rule.column).isNull() | ~_accepted(df, rule)
    bad = F.col(f"{tag}_bad")
    return Compiled({f"{tag}_bad": F.count_if(invalid)}, bad > 0, bad, {"invalid_count": bad})


def _max_null_ratio(df: DataFrame, rule: Rule, tag: str) -> Compiled:
    nulls, rows = F.col(f"{tag}_null"), F.col("row_count")
    ratio = F.when(rows > 0, nulls / rows).otherwise(1.0)
    return Compiled(
        {f"{tag}_null": F.count_if(F.col(rule.column).isNull())},
        ratio > float(rule.ratio or 0.0),
        nulls,
        {"null_count": nulls, "null_ratio": ratio},
    )


def _row_count_between(df: DataFrame, rule: Rule, tag: str) -> Compiled:
    rows, violated = F.col("row_count"), F.lit(False)
    if rule.min_value is not None:
        violated = violated | (rows < int(rule.min_value))
    if rule.max_value is not None:
        violated = violated | (rows > int(rule.max_value))
    return Compiled({}, violated, violated.cast("long"), {})


def _composite_unique(df: DataFrame, rule: Rule, tag: str) -> Compiled:
    bad = F.col(f"{tag}_dup")
    return Compiled({}, bad > 0, bad, {"duplicate_row_count": bad})


RULE_TYPES = {
    "between": _between,
    "accepted_values": _accepted_values,
    "max_null_ratio": _max_null_ratio,
    "row_count_between": _row_count_between,
    "composite_unique": _composite_unique,
}


def duplicate_rows(df: DataFrame, columns: list[str], name: str = "duplicate_rows") -> DataFrame:
    """Number of rows in groups of more than one, nulls equal: one row."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(name))


def evaluate_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule with status, violation count and observed values."""
    df = df.withColumnsRenamed({c: normal_name(c) for c in df.columns})
    compiled: list[Compiled] = []
    for i, rule in enumerate(rules):
        missing = [c for c in rule.columns if c not in df.columns]
        builder = RULE_TYPES.get(rule.rule_type)
        if missing or builder is None:
            seen = {"missing_columns": F.lit(",".join(missing))} if missing else {"unsupported_rule": F.lit(rule.rule_type)}
            compiled.append(Compiled({}, F.lit(True), F.lit(None).cast("long"), seen))
        else:
            compiled.append(builder(df, rule, f"r{i}"))

    counters = [column.alias(name) for c in compiled for name, column in c.counters.items()]
    state = df.agg(F.count("*").alias("row_count"), *counters)
    for i, rule in enumerate(rules):
        if rule.rule_type == "composite_unique" and all(c in df.columns for c in rule.columns):
            # Both sides are one row.
            state = state.crossJoin(F.broadcast(duplicate_rows(df, list(rule.columns), f"r{i}_dup")))

    def result(rule: Rule, c: Compiled) -> Column:
        observed = [F.lit("row_count"), F.col("row_count").cast("string")]
        for key, value in c.observed.items():
            observed += [F.lit(key), value.cast("string")]
        status = F.when(c.violated, rule.severity).otherwise("PASS")
        target = ",".join(rule.columns)
        return F.struct(
            F.lit(rule.id).alias("rule_id"),
            F.lit(rule.rule_type).alias("rule_type"),
            F.lit(target).alias("target"),
            F.lit(rule.severity).alias("severity"),
            status.alias("status"),
            c.violations.cast("long").alias("violations"),
            F.create_map(*observed).alias("observed"),
            F.when(c.violated, F.lit(f"Rule {rule.rule_type} violated on [{target}]."))
            .otherwise(F.lit(f"Rule {rule.rule_type} holds on [{target}]."))
            .alias("message"),
        )

    return state.select(F.inline(F.array(*[result(r, c) for r, c in zip(rules, compiled)])))


def rule_summary(results: DataFrame) -> DataFrame:
    """Counts and worst status over rule results; no rules at all is a pass."""
    failed, warned = F.count_if(F.col("status") == "FAIL"), F.count_if(F.col("status") == "WARN")
    return results.agg(
        F.when(failed > 0, "FAIL").when(warned > 0, "WARN").otherwise("PASS").alias("status"),
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        warned.alias("warned"),
        failed.alias("failed"),
    )


def invalid_samples(df: DataFrame, rule: Rule) -> DataFrame:
    """The first five distinct values outside an accepted-values rule, in text order."""
    bad = df.where(F.col(rule.column).isNotNull() & ~_accepted(df, rule))
    return bad.select(F.col(rule.column).cast("string").alias("value")).distinct().orderBy("value").limit(SAMPLE_SIZE)
