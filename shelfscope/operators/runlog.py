"""Analytics over the preflight run log and its JSON reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.calendar import time_bucket
from shelfscope.functions.text import lower_or, upper_or
from shelfscope.operators.keyed import latest_per_key

SOURCES = ("train", "store")
RULE_SCHEMA = (
    "array<struct<rule_id: string, rule_type: string, severity: string, status: string, message: string, "
    "target: array<string>, observed: map<string, string>>>"
)
SEMANTIC_SCHEMA = (
    f"status string, summary string, counts struct<total: int, passed: int, warned: int, failed: int>, rules {RULE_SCHEMA}"
)


def filtered_runs(
    runs: DataFrame,
    source_name: str | None = None,
    data_source_id: int | None = None,
    mode: str | None = None,
    final_status: str | None = None,
    window: tuple[datetime | None, datetime | None] = (None, None),
) -> DataFrame:
    """Plain predicates, so that they reach the scan; both ends of the window belong to it."""
    if source_name:
        runs = runs.where(F.col("source_name") == source_name)
    if data_source_id is not None:
        runs = runs.where(F.col("data_source_id") == data_source_id)
    if mode:
        runs = runs.where(F.col("mode") == mode)
    if final_status:
        runs = runs.where(F.upper("final_status") == final_status.strip().upper())
    start, end = window
    if start is not None:
        runs = runs.where(F.col("created_at") >= F.lit(start))
    if end is not None:
        runs = runs.where(F.col("created_at") <= F.lit(end))
    return runs


def _status() -> Column:
    return upper_or(F.col("final_status"), "UNKNOWN")


def _counts() -> dict[str, Column]:
    return {
        "total_runs": F.count("*"),
        "pass_count": F.count_if(_status() == "PASS"),
        "warn_count": F.count_if(_status() == "WARN"),
        "fail_count": F.count_if(_status() == "FAIL"),
        "blocked_count": F.count_if("blocked"),
        "used_unified_count": F.count_if("used_unified"),
    }


def run_stats(runs: DataFrame) -> DataFrame:
    """Totals (source null) and the two known sources; the totals come from the per-source counts."""
    by_source = runs.groupBy(F.lower(F.trim("source_name")).alias("source")).agg(
        *[c.alias(name) for name, c in _counts().items()]
    )
    rolled = by_source.rollup("source").agg(
        F.grouping("source").alias("is_total"), *[F.sum(c).alias(c) for c in _counts()]
    )
    rate = F.when(F.col("total_runs") > 0, F.col("used_unified_count") / F.col("total_runs")).otherwise(0.0)
    known = (F.col("is_total") == 1) | F.col("source").isin(*SOURCES)
    return rolled.where(known).withColumn("used_unified_rate", rate).drop("is_total")


def run_trends(runs: DataFrame, bucket: str) -> DataFrame:
    wanted = ("pass_count", "warn_count", "fail_count", "blocked_count")
    timed = runs.where(F.col("created_at").isNotNull())
    return timed.groupBy(time_bucket(F.col("created_at"), bucket).alias("bucket_start")).agg(
        *[c.alias(name) for name, c in _counts().items() if name in wanted]
    )


def _semantic_part(path: str = "") -> Column:
    """Text of the semantic report, or of a part of it, from the first artifact that holds the report: its own,
    else the manifest, else the preflight summary."""
    places = (
        (F.col("semantic_json"), "$"), (F.col("manifest_json"), "$.semantic_quality"), (F.col("preflight_json"), "$.semantic"),
    )
    if not path:
        return F.coalesce(*[F.get_json_object(text, root) for text, root in places])
    chosen = F.lit(None).cast("string")
    for text, root in reversed(places):
        chosen = F.when(F.get_json_object(text, root).isNotNull(), F.get_json_object(text, root + path)).otherwise(chosen)
    return chosen


def with_semantic_report(runs: DataFrame) -> DataFrame:
    return runs.withColumn("semantic", F.from_json(_semantic_part(), SEMANTIC_SCHEMA))


def semantic_overview(runs: DataFrame) -> DataFrame:
    """Status and rule counts per run; missing counts come from the rules, a missing status from the counts."""
    report = F.col("semantic")

    def counted(status: str) -> Column:
        return F.size(F.filter(report["rules"], lambda r: F.upper(F.trim(r["status"])) == status))

    rows = with_semantic_report(runs).where(report.isNotNull())
    counts = report["counts"]
    out = rows.select(
        "run_id",
        F.nullif(F.upper(F.trim(report["status"])), F.lit("")).alias("reported"),
        F.coalesce(counts["total"], F.size(F.coalesce(report["rules"], F.array().cast(RULE_SCHEMA)))).alias("total"),
        F.coalesce(counts["passed"], counted("PASS")).alias("passed"),
        F.coalesce(counts["warned"], counted("WARN")).alias("warned"),
        F.coalesce(counts["failed"], counted("FAIL")).alias("failed"),
    )
    derived = F.when(F.col("failed") > 0, "FAIL").when(F.col("warned") > 0, "WARN").otherwise("PASS")
    return out.select("run_id", F.coalesce("reported", derived).alias("status"), "total", "passed", "warned", "failed")


def rule_events(runs: DataFrame) -> DataFrame:
    """One row per rule of every run that has a report, ids and states normalised."""
    # The generator sits directly on the parser, so each report is parsed once for all fields of its rules;
    # a missing report gives no rows.
    rules = runs.select(
        "run_id", "source_name", "created_at", F.explode(F.from_json(_semantic_part(".rules"), RULE_SCHEMA)).alias("rule")
    )
    return rules.select(
        "run_id",
        "source_name",
        "created_at",
        F.coalesce("rule.rule_id", F.lit("unknown_rule")).alias("rule_id"),
        F.coalesce("rule.rule_type", F.lit("unknown")).alias("rule_type"),
        upper_or(F.col("rule.severity"), "WARN").alias("severity"),
        upper_or(F.col("rule.status"), "UNKNOWN").alias("status"),
        F.coalesce("rule.message", F.lit("")).alias("message"),
    )


def rule_counts(events: DataFrame, keys: tuple[str, ...] = ("rule_id", "rule_type", "severity")) -> DataFrame:
    """Warn and fail counts per rule with the last sighting and the newest non-empty message.

    Events are hashed by rule with numbers of fixed width only. Messages are looked at only in the events of a rule's newest time:
    of these the greatest run id has the message, and of one run's the last in text order.
    """
    bad = events.where(F.col("status").isin("WARN", "FAIL"))
    said = F.col("message") != ""
    counts = bad.groupBy(*keys).agg(
        F.count_if(F.col("status") == "WARN").alias("warn_count"),
        F.count_if(F.col("status") == "FAIL").alias("fail_count"),
        F.max("created_at").alias("last_seen_at"),
        F.max(F.when(said, F.col("created_at"))).alias("said_at"),
    )
    rule = counts.select(*[F.col(k).alias(f"r_{k}") for k in keys], "said_at")
    same = F.col("created_at") == F.col("said_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    newest = bad.where(said).join(rule, same).groupBy(*[F.col(f"r_{k}") for k in keys]).agg(
        F.max(F.struct("run_id", "message")).alias("newest")
    )
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return counts.join(newest, match, "left").select(
        *keys, "warn_count", "fail_count", "last_seen_at", F.col("newest.message").alias("sample_message")
    )


def top_rules(events: DataFrame, limit: int = 10) -> DataFrame:
    ranked = ["fail_count", "warn_count", "last_seen_at", "rule_id", "rule_type", "severity"]
    return rule_counts(events).orderBy(*[F.desc(c) for c in ranked]).limit(max(1, limit))


def run_rollup(runs: DataFrame) -> DataFrame:
    """Status of a run over its sources: the worst one; blocked when any source is."""
    rank = {"FAIL": 3, "WARN": 2, "PASS": 1}
    status = upper_or(F.col("final_status"), "PASS")
    level = F.lit(0)
    for name, value in rank.items():
        level = F.when(status == name, value).otherwise(level)
    rolled = runs.groupBy("run_id").agg(
        F.max(level).alias("level"),
        F.bool_or(F.coalesce("blocked", F.lit(False))).alias("blocked"),
        F.count("*").alias("sources"),
        F.min("created_at").alias("created_at"),
    )
    label = F.lit("SKIPPED")
    for name, value in rank.items():
        label = F.when(F.col("level") == value, name).otherwise(label)
    return rolled.select("run_id", "created_at", label.alias("final_status"), "blocked", "sources")


def status_of(validation: Column, semantic: Column) -> Column:
    """Final status of one source from its validation and semantic status."""
    return (
        F.when((validation == "FAIL") | (semantic == "FAIL"), "FAIL")
        .when((validation == "WARN") | (semantic == "WARN"), "WARN")
        .when((validation == "SKIPPED") & (semantic == "SKIPPED"), "SKIPPED")
        .otherwise("PASS")
    )


def latest_runs(runs: DataFrame, key: str) -> DataFrame:
    return latest_per_key(runs.where(F.col(key).isNotNull()), [key], ["created_at", "run_id"])


def sources_with_health(sources: DataFrame, runs: DataFrame, include_inactive: bool = True) -> DataFrame:
    """Data sources with the status of their newest run, taken over the whole log."""
    last = latest_runs(runs, "data_source_id").select(
        F.col("data_source_id").alias("id"),
        F.col("final_status").alias("last_preflight_status"),
        F.col("created_at").alias("last_preflight_at"),
        F.col("run_id").alias("last_preflight_run_id"),
    )
    return listed_sources(sources, include_inactive).join(last, "id", "left")


def listed_sources(sources: DataFrame, include_inactive: bool = True) -> DataFrame:
    return sources if include_inactive else sources.where("is_active")


def ordered_sources(sources: DataFrame, include_inactive: bool = True) -> DataFrame:
    """Default source first, then by id."""
    return listed_sources(sources, include_inactive).orderBy(F.desc("is_default"), "id")


def run_labels() -> list[Column]:
    """Source, status and mode of a run as metrics name them."""
    return [
        lower_or(F.col("source_name"), "unknown").alias("source_name"),
        upper_or(F.col("final_status"), "UNKNOWN").alias("final_status"),
        lower_or(F.col("mode"), "unknown").alias("mode"),
    ]


def run_metrics(runs: DataFrame) -> DataFrame:
    """Run counts per (source, status, mode) with blocked runs and newest time: the base of three metrics."""
    return runs.groupBy(*run_labels()).agg(
        F.count("*").alias("runs"),
        F.count_if("blocked").alias("blocked_runs"),
        F.max("created_at").alias("latest_at"),
    )


# Experiments -----------------------------------------------------------------------------------------

DRIFT_METRICS = ("mae", "rmse", "wape", "mape")
DRIFT_LIMIT_PCT = 3.0


def experiment_payload(experiments: DataFrame) -> DataFrame:
    """Flat experiment rows with their periods nested."""
    return experiments.select(
        "experiment_id",
        "status",
        "created_at",
        "metrics_json",
        F.struct(
            F.col("train_period_start").alias("start"), F.col("train_period_end").alias("end")
        ).alias("train_period"),
        F.struct(
            F.col("validation_period_start").alias("start"), F.col("validation_period_end").alias("end")
        ).alias("validation_period"),
    )


def experiment_drift(experiments: DataFrame) -> DataFrame:
    """Change of the error metrics between the two newest completed experiments; lower is better.

    No rows when fewer than two are completed.
    """
    newest = (
        experiments.where(F.upper("status") == "COMPLETED")
        .orderBy(F.desc("created_at"), F.desc("experiment_id"))
        .limit(2)
    )
    # Two rows at most from here on.
    metrics = F.from_json("metrics_json", "best struct<mae: double, rmse: double, wape: double, mape: double>")["best"]
    pair = newest.select("created_at", "experiment_id", metrics.alias("m")).agg(
        F.sort_array(F.collect_list(F.struct("created_at", "experiment_id", "m")), asc=False).alias("pair")
    )
    now, past = F.col("pair")[0], F.col("pair")[1]
    rows = pair.where(F.size("pair") == 2).select(
        now["experiment_id"].alias("latest_id"),
        past["experiment_id"].alias("previous_id"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m.upper()).alias("metric"), now["m"][m].alias("current"), past["m"][m].alias("previous"))
                    for m in DRIFT_METRICS
                ]
            )
        ),
    ).where("current IS NOT NULL AND previous IS NOT NULL")
    delta = (F.col("current") - F.col("previous")) / F.greatest(F.abs("previous"), F.lit(1e-8)) * 100
    status = (
        F.when(F.abs("delta") <= DRIFT_LIMIT_PCT, "stable").when(F.col("delta") > 0, "degrading").otherwise("improving")
    )
    return rows.withColumn("delta", delta).select(
        "latest_id",
        "previous_id",
        "metric",
        F.round("current", 4).alias("current"),
        F.round("previous", 4).alias("previous"),
        F.round("delta", 2).alias("delta_pct"),
        status.alias("drift_status"),
    )


def overall_drift(drift: DataFrame) -> DataFrame:
    """Degrading when any metric is, improving when all are, else stable - also without any metric."""
    status = F.col("drift_status")
    return drift.agg(
        F.when(F.count_if(status == "degrading") > 0, "degrading")
        .when((F.count("*") > 0) & (F.count_if(status == "improving") == F.count("*")), "improving")
        .otherwise("stable")
        .alias("overall_drift")
    )
