"""Notification delivery: filters, statistics, dispatch outcomes, replay and attempt durations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.functions.calendar import time_bucket
from shelfscope.functions.numeric import elapsed_ms, is_retryable, mean_of, retry_delay_seconds
from shelfscope.functions.text import safe_error_text, upper_or
from shelfscope.operators.grid import first_rows
from shelfscope.operators.percentile import exact_percentile

# Fixed values.
PENDING = ("PENDING", "RETRYING")
ERROR_STATUSES = ("RETRY", "DEAD", "FAILED")
REPLAYABLE = ("DEAD", "FAILED", "SENT")
LATENCY_BUCKETS_MS = (50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000)
OUTBOX_TO_ATTEMPT = {
    "SENT": ("SENT",),
    "DEAD": ("DEAD",),
    "FAILED": ("FAILED",),
    "RETRYING": ("RETRY",),
    "PENDING": ("STARTED",),
}
TOP_ERRORS = 5
DATE_FIELDS = ("created_at", "updated_at", "next_retry_at", "sent_at", "started_at", "completed_at")


def _window(df: DataFrame, field: str, window: tuple[datetime | None, datetime | None]) -> DataFrame:
    if field not in DATE_FIELDS:
        raise ValueError(f"date field must be one of {DATE_FIELDS}")
    start, end = window
    if start is not None:
        df = df.where(F.col(field) >= F.lit(start))
    return df.where(F.col(field) <= F.lit(end)) if end is not None else df


def filtered_outbox(
    outbox: DataFrame,
    statuses: tuple[str, ...] | None = None,
    event_type: str | None = None,
    channel_target: str | None = None,
    window: tuple[datetime | None, datetime | None] = (None, None),
    date_field: str = "created_at",
    replayed_only: bool = False,
) -> DataFrame:
    if statuses:
        outbox = outbox.where(F.upper("status").isin([s.upper() for s in statuses]))
    if event_type:
        outbox = outbox.where(F.upper("event_type") == event_type.upper())
    if channel_target:
        outbox = outbox.where(F.col("channel_target") == channel_target)
    if replayed_only:
        outbox = outbox.where(F.col("replayed_from_id").isNotNull())
    return _window(outbox, date_field, window)


def filtered_attempts(
    attempts: DataFrame,
    status: str | None = None,
    attempt_status: str | None = None,
    event_type: str | None = None,
    channel_target: str | None = None,
    alert_id=None,
    window: tuple[datetime | None, datetime | None] = (None, None),
    date_field: str = "started_at",
) -> DataFrame:
    """``status`` is an outbox status and is mapped to attempt statuses; it excludes ``attempt_status``."""
    if status and attempt_status:
        raise ValueError("use either status or attempt_status")
    wanted = OUTBOX_TO_ATTEMPT[status.strip().upper()] if status else (attempt_status.upper(),) if attempt_status else None
    if wanted:
        attempts = attempts.where(F.upper("attempt_status").isin(*wanted))
    if event_type:
        attempts = attempts.where(F.upper("event_type") == event_type.upper())
    if channel_target:
        attempts = attempts.where(F.col("channel_target") == channel_target)
    if alert_id is not None:
        attempts = attempts.where(F.col("alert_id") == alert_id)
    return _window(attempts, date_field, window)


def due_items(
    outbox: DataFrame, now: datetime, limit: int | None = None, statuses: tuple[str, ...] = PENDING
) -> DataFrame:
    """Items to be sent now, the longest due first: all of them, or as many as the caller can take."""
    due = outbox.where(F.col("status").isin(*statuses) & (F.col("next_retry_at") <= F.lit(now)))
    return first_rows(due.orderBy("next_retry_at", "created_at", "id"), limit)


# Statistics ------------------------------------------------------------------------------------------


def _attempt_counts() -> dict[str, Column]:
    status = F.upper("attempt_status")
    return {
        "sent_count": F.count_if(status == "SENT"),
        "retry_count": F.count_if(status == "RETRY"),
        "dead_count": F.count_if(status == "DEAD"),
        "replay_count": F.count_if(F.col("replayed_from_id").isNotNull()),
    }


def _latency() -> Column:
    return F.when(F.col("duration_ms") >= 0, F.col("duration_ms"))


def _rate(part: Column, *rest: Column) -> Column:
    whole = part
    for other in rest:
        whole = whole + other
    return F.when(whole > 0, part / whole).otherwise(0.0)


def delivery_stats(attempts: DataFrame, outbox: DataFrame, now: datetime) -> DataFrame:
    """Delivery totals as one row; the success rate counts failed attempts as completed."""
    totals = attempts.agg(
        F.count("*").alias("total_events"),
        *[c.alias(n) for n, c in _attempt_counts().items()],
        F.count_if(F.upper("attempt_status") == "FAILED").alias("failed_count"),
        mean_of(_latency()).alias("avg_delivery_latency_ms"),
    )
    p95 = exact_percentile(attempts.select(_latency().alias("ms")), "ms", 0.95, levels=2).select(
        F.col("percentile").alias("p95_delivery_latency_ms")
    )
    age = F.floor((F.unix_micros(F.lit(now)) - F.unix_micros(F.min("created_at"))) / 1000000)
    waiting = outbox.where(F.col("status").isin(*PENDING)).agg(
        F.count("*").alias("pending_count"),
        F.when(age >= 0, age.cast("long")).when(age < 0, 0).alias("oldest_pending_age_seconds"),
    )
    # Three one-row frames.
    joined = totals.crossJoin(F.broadcast(p95)).crossJoin(F.broadcast(waiting))
    rate = _rate(F.col("sent_count"), F.col("dead_count"), F.col("failed_count"))
    return joined.withColumn("success_rate", rate).drop("failed_count")


def delivery_trends(attempts: DataFrame, bucket: str) -> DataFrame:
    timed = attempts.where(F.col("started_at").isNotNull())
    return timed.groupBy(time_bucket(F.col("started_at"), bucket).alias("bucket_start")).agg(
        *[c.alias(n) for n, c in _attempt_counts().items()],
        mean_of(_latency()).alias("avg_delivery_latency_ms"),
    )


def _channel() -> Column:
    return F.coalesce(F.nullif(F.trim("channel_target"), F.lit("")), F.lit("unknown"))


def channel_summary(attempts: DataFrame, outbox: DataFrame) -> DataFrame:
    """Per channel, from both sides: attempt counts and latency, waiting items, top error codes.

    The success rate leaves failed attempts out. Error codes are counted per channel first and the five
    largest picked from these counts.
    """
    target = _channel().alias("channel_target")
    completed, failed = F.col("completed_at"), F.nullif(F.trim("error_code"), F.lit("")).isNotNull()
    stats = attempts.groupBy(target).agg(
        *[c.alias(n) for n, c in _attempt_counts().items()],
        mean_of(_latency()).alias("avg_delivery_latency_ms"),
        F.max(F.when(F.upper("attempt_status") == "SENT", completed)).alias("last_sent_at"),
        F.max(F.when(failed, completed)).alias("last_error_at"),
    )
    waiting = outbox.where(F.col("status").isin(*PENDING)).groupBy(target).agg(F.count("*").alias("pending_count"))
    codes = (
        attempts.where(failed)
        .groupBy(target, F.upper(F.trim("error_code")).alias("code"))
        .agg(F.count("*").alias("n"))
    )
    order = W.partitionBy("channel_target").orderBy(F.desc("n"), "code")
    top = codes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP_ERRORS)
    listed = top.groupBy("channel_target").agg(
        F.sort_array(F.collect_list(F.struct("place", "code", "n"))).alias("codes")
    )
    text = F.array_join(F.transform("codes", lambda c: F.concat(c["code"], F.lit("="), c["n"].cast("string"))), ",")
    counts = [*_attempt_counts(), "pending_count"]
    return (
        stats.join(waiting, "channel_target", "full")
        .join(listed.select("channel_target", text.alias("top_error_codes")), "channel_target", "left")
        .fillna(0, subset=counts)
        .withColumn("success_rate", _rate(F.col("sent_count"), F.col("dead_count")))
    )


def attempt_labels() -> list[Column]:
    """Channel, event and status of an attempt as metrics name them."""
    return [
        F.coalesce("channel_target", F.lit("unknown")).alias("channel_target"),
        F.upper(F.coalesce("event_type", F.lit("UNKNOWN"))).alias("event_type"),
        F.upper(F.coalesce("attempt_status", F.lit("UNKNOWN"))).alias("attempt_status"),
    ]


def attempt_metrics(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy(*attempt_labels()).agg(F.count("*").alias("attempts"))


def latency_histogram(
    attempts: DataFrame, buckets: tuple[int, ...] = LATENCY_BUCKETS_MS, groups: tuple[str, ...] = ()
) -> DataFrame:
    """Cumulative latency histogram with sum and count, one aggregate unpivoted to (le, cumulative)."""
    valid = F.col("duration_ms") >= 0
    one = attempts.groupBy(*groups).agg(
        F.count_if(valid).alias("n"),
        F.coalesce(F.sum(F.when(valid, F.col("duration_ms"))), F.lit(0)).alias("total"),
        *[F.count_if(valid & (F.col("duration_ms") <= b)).alias(f"b{b}") for b in buckets],
    )
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{b}").alias("cumulative")) for b in buckets]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("n").alias("cumulative")))
    return one.select(
        *groups, F.col("total").alias("latency_sum_ms"), F.col("n").alias("latency_count"), F.inline(F.array(*rows))
    )


def outbox_counts(outbox: DataFrame) -> DataFrame:
    waiting = F.col("status").isin(*PENDING)
    return outbox.agg(
        F.count_if(waiting).alias("pending_count"),
        F.count_if(F.col("status") == "DEAD").alias("dead_count"),
        F.count_if(F.col("replayed_from_id").isNotNull()).alias("replayed_count"),
        F.min(F.when(waiting, F.col("created_at"))).alias("oldest_pending_at"),
    )


# Dispatch --------------------------------------------------------------------------------------------


def dispatch_outcomes(due: DataFrame, outcomes: DataFrame, channels: list[dict], now: datetime) -> DataFrame:
    """New state of every due item from the result of its delivery.

    ``outcomes`` has one row per item: id, success, http_status, error_code, error. Channel settings are
    configuration, compiled into the plan as a map literal. An item dies when its channel is missing,
    disabled or without target, when the error cannot be retried, or when its attempts are used up; an item
    without an outcome counts as an unexpected, retryable error.
    """
    item = with_channel(due.join(outcomes, "id", "left"), channels)
    return outcome_rows(item.withColumn("attempt", F.coalesce("attempt_count", F.lit(0)) + 1), F.lit(now))


def with_channel(items: DataFrame, channels: list[dict]) -> DataFrame:
    """``items`` with ``channel``: the settings of their channel, null where it is missing or disabled."""
    usable = {c["id"]: c for c in channels if c.get("enabled", True)}
    settings = F.create_map(
        *[
            v
            for key, c in usable.items()
            for v in (
                F.lit(key),
                F.struct(
                    F.lit(bool(c.get("target_url"))).alias("has_target"),
                    F.lit(int(c.get("backoff_seconds", 30))).alias("backoff"),
                ),
            )
        ]
    )
    return items.withColumn("channel", settings[F.col("channel_target")])


def _undeliverable() -> tuple[Column, Column]:
    """(the channel is missing, it has no target)."""
    missing = F.col("channel").isNull()
    return missing, ~missing & ~F.col("channel.has_target")


def ends_item() -> Column:
    """Whether an outcome ends its item whatever the number of attempts."""
    missing, no_target = _undeliverable()
    code = F.col("http_status")
    retryable = F.when(code.isNotNull(), is_retryable(code)).otherwise(True)
    return missing | no_target | F.coalesce("success", F.lit(False)) | ~retryable


def outcome_rows(item: DataFrame, moment: Column) -> DataFrame:
    """State of items with ``channel`` after the outcome of their ``attempt``, at ``moment``."""
    missing, no_target = _undeliverable()
    success = F.coalesce("success", F.lit(False))
    retry = ~ends_item() & (F.col("attempt") < F.col("max_attempts"))
    status = (
        F.when(missing | no_target, "DEAD").when(success, "SENT").when(retry, "RETRYING").otherwise("DEAD")
    )
    code = (
        F.when(missing, "CHANNEL_UNAVAILABLE")
        .when(no_target, "CHANNEL_TARGET_MISSING")
        .when(~success, upper_or(F.col("error_code"), "UNEXPECTED_ERROR"))
    )
    delay = retry_delay_seconds(F.col("channel.backoff"), F.col("attempt"))
    return item.select(
        "id",
        "channel_target",
        "event_type",
        F.col("attempt").alias("attempt_count"),
        status.alias("status"),
        F.when(~missing & ~no_target, F.col("http_status")).alias("last_http_status"),
        code.alias("last_error_code"),
        F.when(~success, safe_error_text(F.col("error"))).alias("last_error"),
        F.when(retry, F.timestamp_micros(F.unix_micros(moment) + delay * 1000000)).alias("next_retry_at"),
        F.when(status == "SENT", moment).alias("sent_at"),
    )


def replayed(outbox: DataFrame, now: datetime, statuses: tuple[str, ...] = REPLAYABLE) -> DataFrame:
    """Copies of finished items as new pending deliveries; the event id stays, the attempt count restarts.

    The new id is a digest of the old id and the replay time, so that a task run again after a lost executor
    writes the same ids.
    """
    items = outbox.where(F.col("status").isin(*statuses))
    new_id = F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.lit(now.isoformat())), 256)
    return items.select(
        F.substring(new_id, 1, 32).alias("id"),
        "event_id",
        F.substring(new_id, 33, 32).alias("delivery_id"),
        F.col("id").alias("replayed_from_id"),
        "channel_target",
        "event_type",
        F.lit("PENDING").alias("status"),
        F.lit(0).alias("attempt_count"),
        "max_attempts",
        F.lit(now).alias("next_retry_at"),
        F.lit(now).alias("created_at"),
    )


def attempt_durations(started: DataFrame, completed: DataFrame) -> DataFrame:
    """Start and completion events paired by attempt id; open attempts have no duration."""
    ends = completed.select("attempt_id", "completed_at", "attempt_status")
    return started.join(ends, "attempt_id", "left").select(
        "attempt_id",
        "started_at",
        "completed_at",
        F.coalesce("attempt_status", F.lit("STARTED")).alias("attempt_status"),
        elapsed_ms(F.col("started_at"), F.col("completed_at")).alias("duration_ms"),
    )
