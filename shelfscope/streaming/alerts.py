"""Alert evaluation as Structured Streaming: trailing-window metrics, then the state machine per policy.

Run events are counted per hour first and only these counts enter the sliding windows, so an event is not
copied once per window. Ticks are a second input: without them no window would close while no run arrives, and an
alert could not resolve. Late events are accepted for ``LATENESS``; the batch job over the whole log is the
reference for the results.

Windows are [end - days, end). An event exactly on a tick counts from the next tick on; the batch form, whose
windows include both ends, counts it at that tick already.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfscope.functions.numeric import compare
from shelfscope.sources.policies import Policy, policy_frame

LATENESS = "1 hour"
EVALUATION_SCHEMA = (
    "policy_id string, evaluated_at timestamp, current_value double, condition_met boolean, pending_evaluations int"
)
STATE_SCHEMA = "status string, consecutive int, first_seen_at timestamp, evaluated_at timestamp"
OUTPUT_SCHEMA = (
    "policy_id string, evaluated_at timestamp, current_value double, status string, previous_status string, "
    "consecutive_breaches int, first_seen_at timestamp, event_type string"
)


def evaluation_stream(runs: DataFrame, ticks: DataFrame, policies: list[Policy], lateness: str = LATENESS) -> DataFrame:
    """Policy values at every hourly tick.

    ``runs``: source_name, created_at, final_status, blocked, used_unified and failed_rules (ids of the rules
    that failed). ``ticks``: created_at only. Policies with the same window length share one aggregation.
    """
    branches = [
        _for_window(runs, ticks, [p for p in policies if p.window_days == days], days, lateness)
        for days in sorted({p.window_days for p in policies if p.enabled})
    ]
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out


def _for_window(runs: DataFrame, ticks: DataFrame, policies: list[Policy], days: int, lateness: str) -> DataFrame:
    spark = runs.sparkSession
    status = F.upper(F.trim("final_status"))
    events = runs.select(
        F.explode(F.array("source_name", F.lit("*"))).alias("scope"),
        "created_at",
        F.lit(1).alias("n"),
        (status == "FAIL").cast("int").alias("fails"),
        F.col("blocked").cast("int").alias("blocked"),
        F.col("used_unified").cast("int").alias("unified"),
        F.coalesce("failed_rules", F.array().cast("array<string>")).alias("failed_rules"),
    )
    scopes = sorted({p.policy_source or "*" for p in policies})
    clock = ticks.select(
        F.explode(F.array(*[F.lit(name) for name in scopes])).alias("scope"),
        "created_at",
        *[F.lit(0).alias(c) for c in ("n", "fails", "blocked", "unified")],
        F.array().cast("array<string>").alias("failed_rules"),
    )
    # Configuration: a handful of rows, matched by equality on the source ("*" for any).
    rows = policy_frame(spark, policies).withColumn("scope", F.coalesce("policy_source", F.lit("*")))
    matched = events.unionByName(clock).withWatermark("created_at", lateness).join(F.broadcast(rows), "scope")

    # One key per rule for the rule metrics, the empty key for all others and for ticks.
    on_rules = F.col("metric_type").isin("top_rule_fail_count", "semantic_rule_fail_count")
    wanted = F.filter(
        F.col("failed_rules"), lambda r: F.col("policy_rule").isNull() | (r == F.col("policy_rule"))
    )
    keys = F.when(on_rules, F.concat(F.array(F.lit("")), wanted)).otherwise(F.array(F.lit("")))
    keyed = matched.withColumn("rule_key", F.explode(keys))
    meta = ["policy_id", "metric_type", "operator", "threshold", "pending_evaluations"]
    counts = ["n", "fails", "blocked", "unified"]
    hourly = keyed.groupBy(F.window("created_at", "1 hour"), *meta, "rule_key").agg(
        *[F.sum(c).alias(c) for c in counts]
    )
    trailing = hourly.groupBy(
        F.window(F.window_time("window"), f"{days} days", "1 hour").alias("window"), *meta, "rule_key"
    ).agg(*[F.sum(c).alias(c) for c in counts])
    total = F.col("n")
    rule_fails = F.when(F.col("rule_key") == "", 0).otherwise(F.col("n"))
    value = (
        F.when(F.col("metric_type") == "fail_rate", F.when(total > 0, F.col("fails") / total).otherwise(0.0))
        .when(F.col("metric_type") == "unified_usage_rate", F.when(total > 0, F.col("unified") / total).otherwise(0.0))
        .when(F.col("metric_type") == "blocked_count", F.col("blocked").cast("double"))
        .when(F.col("metric_type") == "fail_count", F.col("fails").cast("double"))
        .otherwise(rule_fails.cast("double"))
    )
    per_tick = trailing.withColumn("value", value).groupBy(
        F.window(F.window_time("window"), "1 hour").alias("tick"), *meta
    ).agg(F.max("value").alias("current_value"))
    return per_tick.select(
        "policy_id",
        F.col("tick.end").alias("evaluated_at"),
        "current_value",
        compare(F.col("current_value"), F.col("operator"), F.col("threshold")).alias("condition_met"),
        "pending_evaluations",
    )


def _next(state: tuple, met: bool, now, needed: int) -> tuple[tuple, str, str | None]:
    """State after one evaluation, its status, and the notification it causes."""
    held, count, first = state
    if met:
        count = count + 1 if held else 1
        status = "FIRING" if count >= needed else "PENDING"
        event = "ALERT_FIRING" if status == "FIRING" and held != "FIRING" else None
        return (status, count, first if held else now), status, event
    if held:
        return (None, 0, None), "RESOLVED", "ALERT_RESOLVED" if held == "FIRING" else None
    return (None, 0, None), "OK", None


def _moment(value) -> pd.Timestamp | None:
    return None if value is None or pd.isna(value) else pd.Timestamp(value)


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """All new evaluations of one policy in time order; the state is its status, breach count, first sight and last evaluation.

    Without state a policy starts from what its rows say is known. Evaluations that are no newer than the last one are done already.
    One micro-batch holds a policy's ticks since the last one, a few rows.
    """
    rows = pd.concat(list(frames)).sort_values("evaluated_at")
    if state.exists:
        *current, last = tuple(state.get)
    else:
        known = rows.iloc[0]
        held = None if pd.isna(known["known_status"]) else known["known_status"]
        current = (held, int(known["known_breaches"]), known["known_first"])
        last = known["known_last"]
    current, last = (*current[:2], _moment(current[2])), _moment(last)
    rows = rows if last is None else rows[rows["evaluated_at"] > last]
    out = []
    for row in rows.itertuples(index=False):
        previous, before = current[0], current[2]
        current, status, event = _next(current, bool(row.condition_met), row.evaluated_at, row.pending_evaluations)
        first = before if status == "RESOLVED" else current[2]
        out.append((key[0], row.evaluated_at, row.current_value, status, previous, current[1], first, event))
        last = row.evaluated_at
    if last is not None:
        state.update((*current[:2], None if current[2] is None else current[2].to_pydatetime(), last.to_pydatetime()))
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT_SCHEMA.split(", ")]).astype({"first_seen_at": "datetime64[ns]"})


def known_states(states: DataFrame) -> DataFrame:
    """Where a stream goes on from: the newest row of every policy in the batch job's ``alert_states``; a row a policy."""
    newest = states.groupBy("policy_id").agg(F.max("evaluated_at").alias("known_last"))
    held = F.col("status").isin("PENDING", "FIRING")
    newest = newest.withColumnRenamed("policy_id", "known_policy")
    same = (F.col("policy_id") == F.col("known_policy")) & (F.col("evaluated_at") == F.col("known_last"))
    return states.join(newest, same).select(
        "policy_id",
        F.when(held, F.col("status")).alias("known_status"),
        F.when(held, F.col("consecutive_breaches")).otherwise(0).cast("int").alias("known_breaches"),
        F.when(held, F.col("first_seen_at")).alias("known_first"),
        "known_last",
    )


def state_stream(evaluations: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """State machine over an evaluation stream: one output row per evaluation, as the batch form gives.

    ``known``, a stored result of :func:`known_states`, is where policies without state start from. Evaluations up to
    its last one may be in the stream again: they are neither counted nor reported twice.
    """
    if known is None:
        missing = {"known_status": "string", "known_breaches": "int", "known_first": "timestamp", "known_last": "timestamp"}
        rows = evaluations.withColumns({name: F.lit(None).cast(kind) for name, kind in missing.items()})
    else:
        rows = evaluations.join(known, "policy_id", "left")
    return rows.fillna({"known_breaches": 0}).groupBy("policy_id").applyInPandasWithState(
        _advance, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )
