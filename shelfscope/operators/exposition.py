"""All operational metrics as one long table of (metric, labels, value), and its text form."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.operators import delivery, runlog
from shelfscope.operators.alerts import active_silences

LABELS = "map<string,string>"


def _labels(*names: str) -> Column:
    if not names:
        return F.create_map().cast(LABELS)
    return F.create_map(*[c for n in names for c in (F.lit(n), F.col(n).cast("string"))])


def _row(metric: str, value: Column | str, *labels: str, when: Column | None = None) -> Column:
    """One metric row, null where ``when`` doesn't hold."""
    value = F.col(value) if isinstance(value, str) else value
    row = F.struct(F.lit(metric).alias("metric"), _labels(*labels).alias("labels"), value.cast("double").alias("value"))
    return row if when is None else F.when(when, row)


def _rows(aggregated: DataFrame, *rows: Column) -> DataFrame:
    return aggregated.select(F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))


def _run_rows(runs: DataFrame) -> DataFrame:
    """Run counts by source, status and mode, and by source alone, as two grouping sets of one aggregate."""
    named = runs.select(*runlog.run_labels(), "blocked", "created_at")
    by = ["source_name", "final_status", "mode"]
    sets = named.groupingSets([by, ["source_name"]], *by).agg(
        F.grouping_id().alias("set"), F.count("*").alias("runs"), F.count_if("blocked").alias("blocked"),
        F.unix_seconds(F.max("created_at")).alias("latest"),
    )
    each, source = F.col("set") == 0, F.col("set") > 0
    return _rows(
        sets,
        _row("preflight_runs_total", "runs", *by, when=each),
        _row("preflight_blocked_total", "blocked", "source_name", when=source & (F.col("blocked") > 0)),
        _row("preflight_latest_run_timestamp_seconds", "latest", "source_name", when=source),
    )


def _attempt_rows(attempts: DataFrame) -> DataFrame:
    """Attempts by channel, event and status, and their latencies over all, as two grouping sets of one aggregate.

    Grouping sets give no row for no input, so a row that counts nowhere goes along: without attempts all totals are zero.
    """
    by = ["channel_target", "event_type", "attempt_status"]
    valid = F.col("duration_ms") >= 0
    rows = attempts.select(*delivery.attempt_labels(), "duration_ms", F.lit(True).alias("real"))
    nowhere = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[:-1]]
    rows = rows.unionByName(attempts.sparkSession.range(1).select(*nowhere, F.lit(False).alias("real")))
    sets = rows.groupingSets([by, []], *by).agg(
        F.grouping_id().alias("set"), F.count_if("real").alias("attempts"), F.count_if(valid).alias("n"),
        F.coalesce(F.sum(F.when(valid, F.col("duration_ms"))), F.lit(0)).alias("total"),
        F.count_if(F.col("attempt_status").isin(*delivery.ERROR_STATUSES)).alias("errors"),
        *[F.count_if(valid & (F.col("duration_ms") <= b)).alias(f"b{b}") for b in delivery.LATENCY_BUCKETS_MS],
    )
    each, whole = (F.col("set") == 0) & (F.col("attempts") > 0), F.col("set") > 0
    latency = "preflight_notifications_delivery_latency_ms"
    bounds = [(str(b), f"b{b}") for b in delivery.LATENCY_BUCKETS_MS] + [("+Inf", "n")]
    steps = [
        F.when(whole, F.struct(F.lit(f"{latency}_bucket").alias("metric"), F.create_map(F.lit("le"), F.lit(le)).alias("labels"),
                               F.col(n).cast("double").alias("value")))
        for le, n in bounds
    ]
    return _rows(
        sets,
        _row("preflight_notifications_attempts_total", "attempts", *by, when=each),
        *steps,
        _row(f"{latency}_sum", "total", when=whole),
        _row(f"{latency}_count", "n", when=whole),
        _row("preflight_notifications_dispatch_errors_total", "errors", when=whole),
    )


def _outbox_rows(outbox: DataFrame, now: datetime) -> DataFrame:
    age = F.unix_seconds(F.lit(now)) - F.unix_seconds("oldest_pending_at")
    return _rows(
        delivery.outbox_counts(outbox),
        _row("preflight_notifications_outbox_pending", "pending_count"),
        _row("preflight_notifications_outbox_dead", "dead_count"),
        _row("preflight_notifications_replays_total", "replayed_count"),
        _row("preflight_notifications_outbox_oldest_pending_age_seconds", F.greatest(F.coalesce(age, F.lit(0)), F.lit(0))),
    )


def metric_table(
    runs: DataFrame,
    alert_states: DataFrame,
    audit: DataFrame,
    silences: DataFrame,
    attempts: DataFrame,
    outbox: DataFrame,
    now: datetime,
) -> DataFrame:
    """Every metric family; each table is read once and its aggregate gives all the families that come from it."""
    active = alert_states.where(F.col("status").isin("PENDING", "FIRING")).groupBy("severity", "status").agg(
        F.count("*").alias("n")
    )
    events = audit.groupBy(F.upper("event_type").alias("event_type")).agg(F.count("*").alias("n"))
    muted = active_silences(silences, now).agg(F.count("*").alias("n"))
    return (
        _run_rows(runs)
        .unionByName(_rows(active, _row("preflight_alerts_active", "n", "severity", "status")))
        .unionByName(_rows(events, _row("preflight_alert_transitions_total", "n", "event_type")))
        .unionByName(_rows(muted, _row("preflight_alert_silences_active", "n")))
        .unionByName(_attempt_rows(attempts))
        .unionByName(_outbox_rows(outbox, now))
    )


def exposition_lines(metrics: DataFrame) -> DataFrame:
    """One text line per metric: labels in name order, values escaped, numbers without trailing zeros."""

    def escaped(value: Column) -> Column:
        for raw, safe in (("\\", "\\\\"), ("\n", "\\n"), ('"', '\\"')):
            value = F.replace(value, F.lit(raw), F.lit(safe))
        return value

    names = F.array_sort(F.map_keys("labels"))
    pairs = F.transform(names, lambda k: F.concat(k, F.lit('="'), escaped(F.col("labels")[k]), F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", "value"), "0+$", ""), r"\.$", "")
    number = F.when(~finite, "0").otherwise(fixed)
    return metrics.select("metric", F.concat("metric", labels, F.lit(" "), number).alias("line"))
