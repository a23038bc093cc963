"""Alert policies over the run log: trailing-window metrics, the alert state machine, overlays and fan-out.

Evaluation happens at ticks (every hour by default). Runs are counted per source and tick before anything
touches a policy, so the heavy part is one map-side combined aggregate; what follows grows with ticks and
policies, not with runs.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfscope.functions.numeric import compare
from shelfscope.operators.grid import first_rows
from shelfscope.operators.keyed import latest_per_key
from shelfscope.sources.policies import Policy, policy_frame

TICK_SECONDS = 3600
RUN_COUNTS = ("total_runs", "fail_count", "blocked_count", "unified_count")
SEVERITY_RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def _tick_of(ts: Column) -> tuple[Column, Column]:
    """Number of the first tick at or after ``ts``, and whether ``ts`` lies exactly on it."""
    micros, width = F.unix_micros(ts), TICK_SECONDS * 1000000
    short = F.pmod(-micros, F.lit(width))
    # The dividend is a multiple of the tick and below 2^53, so the quotient is exact.
    return ((micros + short) / width).cast("long"), short == 0


def tick_time(tick: Column) -> Column:
    return F.timestamp_seconds(tick * TICK_SECONDS)


def tick_span(runs: DataFrame) -> DataFrame:
    """First and last tick of the log: one row."""
    tick, _ = _tick_of(F.col("created_at"))
    return runs.agg(F.min(tick).alias("first"), F.max(tick).alias("last")).where("first IS NOT NULL")


def _per_tick(rows: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    tick, on_tick = _tick_of(F.col("created_at"))
    return rows.groupBy("source_name", *keys, tick.alias("tick"), on_tick.alias("on_tick")).agg(
        *[c.alias(name) for name, c in counts.items()]
    )


def _changes(per_tick: DataFrame, policies: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Rise and fall of every policy's trailing-window counts.

    A count enters at its tick and leaves once the window has passed it: two signed rows instead of a join
    of every tick with all runs of its window. Both window ends belong to the window, so a run exactly on a
    tick stays one tick longer. A policy for any source meets the counts under the source "*", so matching is
    by equality; the policies are one configuration file.
    """
    any_source = F.lit("*")
    matched = per_tick.withColumn("_source", F.explode(F.array("source_name", any_source))).join(
        F.broadcast(policies.withColumn("_source", F.coalesce("policy_source", any_source))), "_source"
    )
    width = (F.col("window_days") * (86400 // TICK_SECONDS)).cast("long")
    leaves = F.col("tick") + width + F.col("on_tick").cast("long")
    signed = matched.select(
        "policy_id",
        *keys,
        *counts,
        F.inline(
            F.array(
                F.struct(F.col("tick").alias("at"), F.lit(1).alias("sign")),
                F.struct(leaves.alias("at"), F.lit(-1).alias("sign")),
            )
        ),
    )
    return signed.groupBy("policy_id", *keys, F.col("at").alias("tick")).agg(
        *[F.sum(F.col(c) * F.col("sign")).alias(c) for c in counts]
    )


def _trailing_runs(per_tick: DataFrame, policies: DataFrame, span: DataFrame, counts: list[str]) -> DataFrame:
    """Trailing run counts of every policy at every tick of the span, ticks without a change included."""
    base = policies.select("policy_id").crossJoin(F.broadcast(span)).select(
        "policy_id", F.explode(F.sequence("first", "last")).alias("tick")
    )
    series = W.partitionBy("policy_id").orderBy("tick").rowsBetween(W.unboundedPreceding, 0)
    dense = base.join(_changes(per_tick, policies, [], counts), ["policy_id", "tick"], "left").fillna(0, subset=counts)
    return dense.select("policy_id", "tick", *[F.sum(c).over(series).alias(c) for c in counts])


def _trailing_rules(per_tick: DataFrame, policies: DataFrame, span: DataFrame) -> DataFrame:
    """Largest trailing fail count over the rules a policy looks at, at every tick where there is one.

    Between two changes of a rule its count stands still, so each running sum is spread over the ticks up to
    the next change.
    """
    changes = _changes(per_tick, policies, ["rule_id", "policy_rule"], ["rule_fails"]).where(
        F.col("policy_rule").isNull() | (F.col("policy_rule") == F.col("rule_id"))
    )
    series = W.partitionBy("policy_id", "rule_id").orderBy("tick")
    level = F.sum("rule_fails").over(series.rowsBetween(W.unboundedPreceding, 0))
    spread = changes.select(
        "policy_id", level.alias("rule_fails"), "tick", (F.lead("tick").over(series) - 1).alias("until")
    ).crossJoin(F.broadcast(span))
    end = F.least(F.coalesce("until", "last"), F.col("last"))
    ticks = spread.where(F.col("tick") <= F.col("last")).select(
        "policy_id", "rule_fails", F.explode(F.sequence("tick", end)).alias("tick")
    )
    return ticks.groupBy("policy_id", "tick").agg(F.max("rule_fails").alias("rule_fails"))


def alert_metrics(runs: DataFrame, rule_events: DataFrame, policies: list[Policy]) -> DataFrame:
    """Metric value of every enabled policy at every tick, with breach flag."""
    spark = runs.sparkSession
    rows = policy_frame(spark, policies)
    span = tick_span(runs)
    status = F.upper(F.trim("final_status"))
    run_ticks = _per_tick(
        runs,
        [],
        {
            "total_runs": F.count("*"),
            "fail_count": F.count_if(status == "FAIL"),
            "blocked_count": F.count_if("blocked"),
            "unified_count": F.count_if("used_unified"),
        },
    )
    on_runs = _trailing_runs(run_ticks, rows, span, list(RUN_COUNTS))

    by_rule = rows.where(F.col("metric_type").isin("top_rule_fail_count", "semantic_rule_fail_count"))
    fails = rule_events.where("status = 'FAIL'")
    rule_ticks = _per_tick(fails, ["rule_id"], {"rule_fails": F.count("*")})
    on_rules = _trailing_rules(rule_ticks, by_rule, span)

    metric = F.col("metric_type")
    total = F.col("total_runs")
    rate = lambda part: F.when(total > 0, F.col(part) / total).otherwise(0.0)
    value = (
        F.when(metric == "fail_rate", rate("fail_count"))
        .when(metric == "unified_usage_rate", rate("unified_count"))
        .when(metric == "blocked_count", F.col("blocked_count").cast("double"))
        .when(metric == "fail_count", F.col("fail_count").cast("double"))
        .otherwise(F.coalesce("rule_fails", F.lit(0)).cast("double"))
    )
    return (
        on_runs.join(on_rules, ["policy_id", "tick"], "left")
        .join(F.broadcast(rows), "policy_id")
        .withColumn("current_value", value)
        .withColumn("condition_met", compare(F.col("current_value"), F.col("operator"), F.col("threshold")))
        .withColumn("evaluated_at", tick_time(F.col("tick")))
    )


def alert_states(evaluations: DataFrame) -> DataFrame:
    """Alert state at every evaluation, as gaps and islands of breaches.

    Breaches in a row are numbered; from ``pending_evaluations`` on the alert fires. The first evaluation
    without a breach after a pending or firing one resolves the alert. A policy's group is one row per tick.
    """
    series = W.partitionBy("policy_id").orderBy("evaluated_at")
    met = F.col("condition_met")
    clears = F.sum(F.when(met, 0).otherwise(1)).over(series.rowsBetween(W.unboundedPreceding, 0))
    island = W.partitionBy("policy_id", "_island").orderBy("evaluated_at")
    numbered = evaluations.withColumn("_island", clears)
    breaches = F.sum(met.cast("int")).over(island.rowsBetween(W.unboundedPreceding, 0))
    first_seen = F.min(F.when(met, F.col("evaluated_at"))).over(island.rowsBetween(W.unboundedPreceding, 0))
    stated = numbered.withColumn("consecutive_breaches", F.when(met, breaches).otherwise(0)).withColumn(
        "first_seen_at", F.when(met, first_seen)
    )
    held = F.when(met & (F.col("consecutive_breaches") >= F.col("pending_evaluations")), "FIRING").when(met, "PENDING")
    stated = stated.withColumn("_held", held).withColumn("previous_status", F.lag("_held").over(series))
    stated = stated.withColumn("_previous_first", F.lag("first_seen_at").over(series))
    status = F.coalesce("_held", F.when(F.col("previous_status").isNotNull(), "RESOLVED"), F.lit("OK"))
    return stated.select(
        "policy_id",
        "severity",
        F.col("policy_source").alias("source_name"),
        F.col("policy_rule").alias("rule_id"),
        "evaluated_at",
        "current_value",
        "threshold",
        "condition_met",
        "consecutive_breaches",
        "previous_status",
        status.alias("status"),
        F.when(met, F.col("first_seen_at")).otherwise(F.col("_previous_first")).alias("first_seen_at"),
        F.when(status == "RESOLVED", F.col("evaluated_at")).alias("resolved_at"),
    )


def _entered() -> Column:
    return (F.col("status") != "OK") & ~F.equal_null("status", "previous_status")


def alert_history(states: DataFrame) -> DataFrame:
    """One row per change of state: entry into pending or firing, and resolution."""
    return states.where(_entered())


def audit_events(states: DataFrame) -> DataFrame:
    """An EVALUATED event for every evaluation and one event per change of state."""
    changed = F.when(_entered(), F.col("status"))
    kinds = F.filter(F.array(F.lit("EVALUATED"), changed), lambda k: k.isNotNull())
    return states.select(
        F.col("policy_id").alias("alert_id"), "evaluated_at", "current_value", F.explode(kinds).alias("event_type")
    )


def transitions(states: DataFrame) -> DataFrame:
    """Changes that notify: entry into firing, and resolution of a firing alert (a pending one ends silently)."""
    event = F.when((F.col("status") == "FIRING") & _entered(), "ALERT_FIRING").when(
        (F.col("status") == "RESOLVED") & (F.col("previous_status") == "FIRING"), "ALERT_RESOLVED"
    )
    return states.withColumn("event_type", event).where("event_type IS NOT NULL")


def fan_out(changes: DataFrame, channels: list[dict]) -> DataFrame:
    """One pending delivery per transition and channel that is enabled, has a target and takes the event.

    Channels are configuration: they sit in the plan as a literal array, so this is a narrow operation.
    """
    usable = [c for c in channels if c.get("enabled", True) and c.get("target_url")]
    listed = F.array(
        *[
            F.struct(
                F.lit(c["id"]).alias("channel_target"),
                F.lit(int(c.get("max_attempts", 5))).alias("max_attempts"),
                F.array(*[F.lit(e) for e in c.get("enabled_event_types", [])]).alias("events"),
            )
            for c in usable
        ]
    )
    wanted = F.filter(listed, lambda c: F.array_contains(c["events"], F.col("event_type")))
    event_id = F.sha2(F.concat_ws("|", "policy_id", F.unix_micros("evaluated_at").cast("string"), "event_type"), 256)
    return changes.select("*", F.substring(event_id, 1, 32).alias("event_id"), F.inline(wanted)).select(
        "event_id",
        F.substring(F.sha2(F.concat_ws("|", "event_id", "channel_target"), 256), 1, 32).alias("delivery_id"),
        "event_type",
        F.col("policy_id").alias("alert_id"),
        "severity",
        "source_name",
        "channel_target",
        "max_attempts",
        F.lit("PENDING").alias("status"),
        F.lit(0).alias("attempt_count"),
        F.col("evaluated_at").alias("created_at"),
    )


# Silences and acknowledgements -----------------------------------------------------------------------

MATCHED = ("policy_id", "source_name", "severity", "rule_id")


def _matchable(name: str) -> Column:
    """Comparable form of a match field; blank means any."""
    text = F.trim(F.col(name).cast("string"))
    text = {"source_name": F.lower, "severity": F.upper}.get(name, lambda c: c)(text)
    return F.nullif(text, F.lit(""))


def expired_silences(silences: DataFrame, now: datetime) -> DataFrame:
    """Silences whose end has passed are marked as expired now."""
    over = F.col("expired_at").isNull() & (F.col("ends_at") <= F.lit(now))
    return silences.withColumn("expired_at", F.when(over, F.lit(now)).otherwise(F.col("expired_at")))


def active_silences(silences: DataFrame, now: datetime, include_expired: bool = False) -> DataFrame:
    """Silences in force at ``now``; or all of them with ``include_expired``."""
    if include_expired:
        return silences
    moment = F.lit(now)
    return silences.where(
        F.col("expired_at").isNull() & (F.col("starts_at") <= moment) & (F.col("ends_at") > moment)
    )


def with_silences(alerts: DataFrame, silences: DataFrame) -> DataFrame:
    """Each alert with the newest silence that matches it, a blank silence field matching anything.

    No nested loop: silences shrink to the newest one per combination of fields, and each distinct
    combination of alert fields looks up its sixteen possible patterns by equality.
    """
    any_value = F.lit("*")
    patterns = silences.select(
        *[F.coalesce(_matchable(c), any_value).alias(f"s_{c}") for c in MATCHED], "silence_id", "created_at"
    )
    patterns = latest_per_key(patterns, [f"s_{c}" for c in MATCHED], ["created_at", "silence_id"])

    keyed = alerts.withColumns({f"a_{c}": F.coalesce(_matchable(c), F.lit("")) for c in MATCHED})
    keys = [f"a_{c}" for c in MATCHED]
    combos = keyed.select(*keys).distinct()
    for c in MATCHED:
        combos = combos.withColumn(f"s_{c}", F.explode(F.array(any_value, F.col(f"a_{c}"))))
    hits = combos.join(patterns, [f"s_{c}" for c in MATCHED])
    best = hits.groupBy(*keys).agg(F.max_by("silence_id", F.struct("created_at", "silence_id")).alias("silence_id"))
    return (
        keyed.join(best, keys, "left")
        .withColumn("is_silenced", F.col("silence_id").isNotNull())
        .drop(*keys)
    )


def active_acknowledgements(commands: DataFrame) -> DataFrame:
    """Alerts whose newest command acknowledges; commands are (command_id, alert_id, command, made_at, actor)."""
    newest = latest_per_key(commands, ["alert_id"], ["made_at", "command_id"])
    return newest.where("command = 'acknowledge'").select(
        "alert_id", F.col("actor").alias("acknowledged_by"), F.col("made_at").alias("acknowledged_at")
    )


def with_acknowledgements(alerts: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    return alerts.join(acknowledgements, "alert_id", "left").withColumn(
        "is_acknowledged", F.col("acknowledged_at").isNotNull()
    )


def listed_alerts(alerts: DataFrame, limit: int | None = None) -> DataFrame:
    """Most severe first, then last seen first."""
    rank = F.lit(0)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(F.col("severity") == name, value).otherwise(rank)
    return first_rows(alerts.orderBy(rank.desc(), F.desc("last_seen_at"), F.desc("alert_id")), limit)
