"""Registered alert queries: metrics, state machine, history, fan-out and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscope.operators import alerts, runlog
from shelfscope.plans.log_queries import SILENCE_NOW, TS
from shelfscope.plans.oracle_tables import oracle
from shelfscope.plans.quality_queries import CONFIG
from shelfscope.plans.registry import Query, presented
from shelfscope.sources import tables
from shelfscope.sources.policies import Policy, load_channels

# Policies whose thresholds the stand-in log crosses again and again; every metric and both scopes occur.
POLICIES = [
    Policy("p1_fail_rate", "HIGH", "train", 1, "fail_rate", ">", 0.2, 2),
    Policy("p2_blocked", "HIGH", None, 7, "blocked_count", ">=", 45.0, 1),
    Policy("p3_unified", "MEDIUM", None, 1, "unified_usage_rate", "<", 0.36, 3),
    Policy("p4_rule", "MEDIUM", "train", 2, "semantic_rule_fail_count", ">", 6.0, 1, "rule_0"),
    Policy("p5_top_rule", "LOW", "store", 1, "top_rule_fail_count", ">=", 9.0, 2),
    Policy("p6_fails", "LOW", None, 3, "fail_count", "<=", 200.0, 1),
    Policy("p7_off", "LOW", None, 3, "fail_count", "!=", 0.0, 1, enabled=False),
]


def _evaluations(spark, sf):
    reports = tables.rule_reports(spark, sf)
    return alerts.alert_metrics(tables.run_log(spark, sf), runlog.rule_events(reports), POLICIES)


def _states(spark, sf):
    return alerts.alert_states(_evaluations(spark, sf))


def _metrics(spark, sf):
    return presented(_evaluations(spark, sf).select("policy_id", "evaluated_at", "current_value", "condition_met"))


def _fan_out(spark, sf):
    out = alerts.fan_out(alerts.transitions(_states(spark, sf)), load_channels(CONFIG / "channels.yaml"))
    return presented(out.drop("delivery_id"))


def _audit(spark, sf):
    events = alerts.audit_events(_states(spark, sf))
    return presented(events.groupBy("alert_id", "event_type").agg(F.count("*").alias("num_events")))


def _silenced(spark, sf):
    active = alerts.active_silences(tables.silences(spark, sf), SILENCE_NOW)
    out = alerts.with_silences(tables.alert_items(spark, sf), active)
    return presented(out.select("alert_id", "policy_id", "silence_id", "is_silenced"))


def _acknowledged(spark, sf):
    items = tables.alert_items(spark, sf).select(F.col("user_id").alias("alert_id"), F.col("alert_id").alias("item_id"))
    active = alerts.active_acknowledgements(tables.acknowledge_commands(spark, sf))
    return presented(alerts.with_acknowledgements(items, active))


def _expired(spark, sf):
    out = alerts.expired_silences(tables.silences(spark, sf), SILENCE_NOW)
    return presented(out.select("silence_id", "ends_at", "expired_at"))


def _final_status(spark, sf):
    """Final status of every run from two statuses, counted per combination."""
    k = F.col("k")
    statuses = F.array(*[F.lit(s) for s in ("PASS", "WARN", "FAIL", "SKIPPED")])
    rows = tables.run_log(spark, sf).select(
        F.get(statuses, k % 4).alias("validation"), F.get(statuses, F.floor(k / 4).cast("int") % 4).alias("semantic"))
    final = runlog.status_of(F.col("validation"), F.col("semantic")).alias("final_status")
    return presented(rows.groupBy("validation", "semantic", final).agg(F.count("*").alias("num_runs")))


EVALUATED_SQL = """
WITH span AS (SELECT MIN((epoch_us(created_at) + 3599999999) // 3600000000) AS a,
                     MAX((epoch_us(created_at) + 3599999999) // 3600000000) AS b FROM run_log),
ticks AS (SELECT make_timestamp(t * 3600000000) AS tick_at FROM span, unnest(generate_series(a, b)) AS u(t)),
pol(policy_id, severity, src, days, metric, op, threshold, k, rule) AS (VALUES
  ('p1_fail_rate', 'HIGH', 'train', 1, 'fail_rate', '>', 0.2::DOUBLE, 2, NULL),
  ('p2_blocked', 'HIGH', NULL, 7, 'blocked_count', '>=', 45, 1, NULL),
  ('p3_unified', 'MEDIUM', NULL, 1, 'unified_usage_rate', '<', 0.36, 3, NULL),
  ('p4_rule', 'MEDIUM', 'train', 2, 'semantic_rule_fail_count', '>', 6, 1, 'rule_0'),
  ('p5_top_rule', 'LOW', 'store', 1, 'top_rule_fail_count', '>=', 9, 2, NULL),
  ('p6_fails', 'LOW', NULL, 3, 'fail_count', '<=', 200, 1, NULL)),
runs AS (SELECT policy_id, tick_at, COUNT(run_id) AS n, COUNT(*) FILTER (final_status = 'FAIL') AS f,
                COUNT(*) FILTER (blocked) AS bl, COUNT(*) FILTER (used_unified) AS u
         FROM pol CROSS JOIN ticks LEFT JOIN run_log
           ON (src IS NULL OR src = source_name) AND created_at >= tick_at - to_days(days) AND created_at <= tick_at
         GROUP BY policy_id, tick_at),
rules AS (SELECT policy_id, tick_at, MAX(c) AS c FROM (
            SELECT policy_id, tick_at, rule_id, COUNT(*) AS c FROM pol CROSS JOIN ticks JOIN rule_log
              ON (src IS NULL OR src = source_name) AND created_at >= tick_at - to_days(days) AND created_at <= tick_at
             AND (rule IS NULL OR rule = rule_id)
            WHERE status = 'FAIL' AND metric IN ('semantic_rule_fail_count', 'top_rule_fail_count')
            GROUP BY policy_id, tick_at, rule_id) GROUP BY policy_id, tick_at),
val AS (SELECT p.*, r.tick_at, CASE metric
            WHEN 'fail_rate' THEN CASE WHEN n > 0 THEN f / n ELSE 0 END
            WHEN 'unified_usage_rate' THEN CASE WHEN n > 0 THEN u / n ELSE 0 END
            WHEN 'blocked_count' THEN CAST(bl AS DOUBLE) WHEN 'fail_count' THEN CAST(f AS DOUBLE)
            ELSE CAST(COALESCE(c, 0) AS DOUBLE) END AS v
        FROM pol p JOIN runs r ON r.policy_id = p.policy_id
        LEFT JOIN rules q ON q.policy_id = r.policy_id AND q.tick_at = r.tick_at),
met AS (SELECT *, CASE op WHEN '>' THEN v > threshold WHEN '>=' THEN v >= threshold WHEN '<' THEN v < threshold
                          ELSE v <= threshold END AS m FROM val),
isl AS (SELECT *, SUM(CASE WHEN m THEN 0 ELSE 1 END) OVER (PARTITION BY policy_id ORDER BY tick_at) AS i FROM met),
run AS (SELECT *, CASE WHEN m THEN SUM(CASE WHEN m THEN 1 ELSE 0 END) OVER w ELSE 0 END AS n,
               CASE WHEN m THEN MIN(CASE WHEN m THEN tick_at END) OVER w END AS first
        FROM isl WINDOW w AS (PARTITION BY policy_id, i ORDER BY tick_at)),
held AS (SELECT *, CASE WHEN m AND n >= k THEN 'FIRING' WHEN m THEN 'PENDING' END AS h FROM run),
st AS (SELECT *, LAG(h) OVER w AS prev, LAG(first) OVER w AS pf FROM held WINDOW w AS (PARTITION BY policy_id ORDER BY tick_at)),
states AS (SELECT *, COALESCE(h, CASE WHEN prev IS NOT NULL THEN 'RESOLVED' END, 'OK') AS status FROM st),
hist AS (SELECT * FROM states WHERE status <> 'OK' AND status IS DISTINCT FROM prev)
"""
STATE_COLUMNS = f"""policy_id, severity, src AS source_name, rule AS rule_id, {TS.format('tick_at')} AS evaluated_at,
    v AS current_value, threshold, m AS condition_met, CAST(n AS BIGINT) AS consecutive_breaches,
    prev AS previous_status, status, {TS.format('CASE WHEN m THEN first ELSE pf END')} AS first_seen_at,
    CASE WHEN status = 'RESOLVED' THEN {TS.format('tick_at')} END AS resolved_at"""
ALERTS = "run_log rule_log"

QUERIES = [
    Query("alert_metrics", "A-17 J-12 J-13 R-1 F-25", _metrics, oracle(ALERTS, EVALUATED_SQL + f"""
        SELECT policy_id, {TS.format('tick_at')} AS evaluated_at, v AS current_value, m AS condition_met FROM met""")),
    Query("alert_state_batch", "R-2", lambda s, d: presented(_states(s, d)),
          oracle(ALERTS, EVALUATED_SQL + f"SELECT {STATE_COLUMNS} FROM states")),
    Query("alert_history", "R-3", lambda s, d: presented(alerts.alert_history(_states(s, d))),
          oracle(ALERTS, EVALUATED_SQL + f"SELECT {STATE_COLUMNS} FROM hist")),
    Query("alert_audit", "R-3 A-24", _audit, oracle(ALERTS, EVALUATED_SQL + """
        SELECT policy_id AS alert_id, 'EVALUATED' AS event_type, COUNT(*) AS num_events FROM states GROUP BY 1
        UNION ALL SELECT policy_id, status, COUNT(*) FROM hist GROUP BY 1, 2""")),
    Query("alert_fan_out", "R-4", _fan_out, oracle(ALERTS, EVALUATED_SQL + f""",
        ev AS (SELECT *, CASE WHEN status = 'FIRING' THEN 'ALERT_FIRING'
                              WHEN status = 'RESOLVED' AND prev = 'FIRING' THEN 'ALERT_RESOLVED' END AS event_type FROM hist),
        ch(channel_target, max_attempts, firing_only) AS (VALUES ('channel_0', 5, FALSE), ('channel_1', 5, TRUE),
                                                                ('channel_2', 3, FALSE))
        SELECT substr(sha256(policy_id || '|' || epoch_us(tick_at) || '|' || event_type), 1, 32) AS event_id, event_type,
               policy_id AS alert_id, severity, src AS source_name, channel_target, CAST(max_attempts AS BIGINT) AS max_attempts, 'PENDING' AS status,
               CAST(0 AS BIGINT) AS attempt_count, {TS.format('tick_at')} AS created_at
        FROM ev, ch WHERE event_type = 'ALERT_FIRING' OR (event_type = 'ALERT_RESOLVED' AND NOT firing_only)""")),
    Query("silence_overlay", "J-8 R-7 P-17", _silenced, oracle("alert_items silences", """
        WITH act AS (SELECT * FROM silences WHERE expired_at IS NULL AND starts_at <= TIMESTAMP '2000-06-01'
                       AND ends_at > TIMESTAMP '2000-06-01'),
        m AS (SELECT a.alert_id, arg_max(s.silence_id, (s.created_at, s.silence_id)) AS silence_id
              FROM alert_items a JOIN act s ON (s.policy_id IS NULL OR s.policy_id = a.policy_id)
                AND (s.source_name IS NULL OR s.source_name = a.source_name)
                AND (s.severity IS NULL OR s.severity = a.severity)
                AND (s.rule_id IS NULL OR s.rule_id = COALESCE(a.rule_id, '')) GROUP BY 1)
        SELECT a.alert_id, a.policy_id, silence_id, silence_id IS NOT NULL AS is_silenced
        FROM alert_items a LEFT JOIN m ON m.alert_id = a.alert_id""")),
    Query("silence_expiry", "P-18", _expired, oracle("silences", f"""
        SELECT silence_id, {TS.format('ends_at')} AS ends_at,
               {TS.format("COALESCE(expired_at, CASE WHEN silences.ends_at <= TIMESTAMP '2000-06-01' THEN TIMESTAMP '2000-06-01' END)")}
                 AS expired_at FROM silences""")),
    Query("acknowledgement_overlay", "J-9 R-7", _acknowledged, f"""
        WITH c AS (SELECT user_id AS alert_id, event_type, ts FROM events WHERE event_type IN ('click', 'view')
                   QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
        a AS (SELECT alert_id, 'user_' || alert_id % 3 AS acknowledged_by, {TS.format('ts')} AS acknowledged_at FROM c
              WHERE event_type = 'click')
        SELECT e.user_id AS alert_id, e.event_id AS item_id, acknowledged_by, acknowledged_at,
               acknowledged_at IS NOT NULL AS is_acknowledged
        FROM events e LEFT JOIN a ON a.alert_id = e.user_id"""),
    Query("active_alert_list", "T-7 X-7", lambda s, d: presented(alerts.listed_alerts(
        tables.alert_items(s, d).where("status = 'FIRING'"), 500).select("alert_id", "severity", "last_seen_at")),
          oracle("alert_items", f"""
        SELECT alert_id, severity, {TS.format('last_seen_at')} AS last_seen_at FROM alert_items WHERE status = 'FIRING'
        ORDER BY CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC,
                 alert_items.last_seen_at DESC, alert_id DESC LIMIT 500""")),
    Query("final_status", "Q-17", _final_status, oracle("run_log", """
        WITH s AS (SELECT ['PASS', 'WARN', 'FAIL', 'SKIPPED'][k % 4 + 1] AS validation,
                          ['PASS', 'WARN', 'FAIL', 'SKIPPED'][k // 4 % 4 + 1] AS semantic FROM run_log)
        SELECT validation, semantic, CASE WHEN 'FAIL' IN (validation, semantic) THEN 'FAIL'
                 WHEN 'WARN' IN (validation, semantic) THEN 'WARN'
                 WHEN validation = 'SKIPPED' AND semantic = 'SKIPPED' THEN 'SKIPPED' ELSE 'PASS' END AS final_status,
               COUNT(*) AS num_runs FROM s GROUP BY 1, 2""")),
]
