"""Registered run-log, delivery and metric queries."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from shelfscope.functions.coerce import to_utc_timestamp
from shelfscope.functions.windows import resolve_window
from shelfscope.operators import alerts, counters, delivery, exposition, grid, runlog
from shelfscope.operators.keyed import upserted
from shelfscope.plans.oracle_tables import oracle
from shelfscope.plans.quality_queries import CONFIG
from shelfscope.plans.registry import Query, presented
from shelfscope.sources import tables
from shelfscope.sources.policies import load_channels

NOW = datetime(2024, 1, 31, 12, 0, tzinfo=timezone.utc)
PAGE_FROM, LAST_ID = datetime(2024, 1, 15, 12, 0, tzinfo=timezone.utc), 500  # last row of the page before
SILENCE_NOW = datetime(2000, 6, 1, tzinfo=timezone.utc)
TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
WINDOW = resolve_window("2024-01-05", "2024-01-20T06:30:00Z")
WINDOW_SQL = "created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-20 06:30:00'"


def _runs(spark, sf):
    return tables.run_log(spark, sf)


def _events(spark, sf):
    return runlog.rule_events(tables.rule_reports(spark, sf))


def _filtered(spark, sf):
    rows = runlog.filtered_runs(_runs(spark, sf), source_name="train", mode="enforce", final_status="fail", window=WINDOW)
    return presented(rows.select("run_id", "created_at", "data_source_id", "blocked"))


def _reports(spark, sf):
    return presented(runlog.semantic_overview(tables.rule_reports(spark, sf)))


def _latest_page(spark, sf):
    rows = _runs(spark, sf).select("run_id", "source_name", "created_at", "final_status")
    return presented(grid.latest_first(rows, "created_at", "run_id", limit=2000))


def _iso(spark, sf):
    """Timestamps written as ISO text with a zone and read back, counted by day."""
    text = F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    rows = _runs(spark, sf).select(to_utc_timestamp(text).alias("at"), "created_at")
    return presented(rows.groupBy(F.to_date("at").alias("day")).agg(
        F.count("*").alias("num_rows"), F.count_if(F.col("at") == F.col("created_at")).alias("same")))


def _upsert(spark, sf):
    """Run records: a RUNNING row per run, then a COMPLETED one for all but every fifth, merged by id."""
    runs = _runs(spark, sf).select("run_id", "created_at", "final_status")
    first = runs.select("run_id", "created_at", F.lit("RUNNING").alias("status"))
    done = runs.where("run_id % 5 <> 0").select("run_id", "created_at", F.col("final_status").alias("status"))
    return presented(upserted(first, done, ["run_id"], "created_at"))


def _filtered_outbox(spark, sf):
    rows = delivery.filtered_outbox(tables.outbox(spark, sf), ("pending", "RETRYING"), "alert_firing", window=WINDOW,
                                    date_field="next_retry_at")
    return presented(rows.select("id", "channel_target", "status", "next_retry_at"))


def _filtered_attempts(spark, sf):
    rows = delivery.filtered_attempts(tables.delivery_attempts(spark, sf), status="RETRYING", event_type="ALERT_RESOLVED",
                                      window=WINDOW)
    return presented(rows.select("attempt_id", "channel_target", "started_at"))


def _newest_attempts(spark, sf):
    rows = tables.delivery_attempts(spark, sf).select("attempt_id", "channel_target", "attempt_status", "started_at")
    return presented(grid.latest_first(rows, "started_at", "attempt_id", limit=500))


def _deliveries_page(spark, sf):
    rows = tables.outbox(spark, sf).where("status = 'DEAD'").select("id", "channel_target", "created_at")
    return presented(grid.page(rows, [F.desc("created_at"), F.desc("id")], page=3, page_size=200))


def _deliveries_after(spark, sf):
    rows = tables.outbox(spark, sf).where("status = 'DEAD'").select("id", "channel_target", "created_at")
    order = [("created_at", True), ("id", True)]
    return presented(grid.page_after(rows, order, 200, {"created_at": PAGE_FROM, "id": LAST_ID}))


def _due(spark, sf):
    return presented(delivery.due_items(tables.outbox(spark, sf), NOW).select("id", "status", "next_retry_at"))


def _dispatch(spark, sf):
    """Every waiting item that is due, not only one batch of them."""
    waiting = tables.outbox(spark, sf).where(F.col("status").isin(*delivery.PENDING))
    channels = load_channels(CONFIG / "channels.yaml")
    return presented(delivery.dispatch_outcomes(waiting, tables.delivery_results(spark, sf), channels, NOW))


def _replayed(spark, sf):
    return presented(delivery.replayed(tables.outbox(spark, sf), NOW).withColumnRenamed("id", "new_id"))


def _durations(spark, sf):
    attempts = tables.delivery_attempts(spark, sf)
    ends = attempts.where("k % 13 <> 0").select("attempt_id", "completed_at", "attempt_status")
    return presented(delivery.attempt_durations(attempts.select("attempt_id", "started_at"), ends))


def _metric_inputs(spark, sf):
    items = tables.alert_items(spark, sf)
    audit = items.select("alert_id", F.col("status").alias("event_type"))
    return exposition.metric_table(
        _runs(spark, sf), items, audit, tables.silences(spark, sf), tables.delivery_attempts(spark, sf),
        tables.outbox(spark, sf), SILENCE_NOW)


def _metric_table(spark, sf):
    names = F.array_sort(F.map_keys("labels"))
    text = F.array_join(F.transform(names, lambda k: F.concat(k, F.lit("="), F.col("labels")[k])), ",")
    return presented(_metric_inputs(spark, sf).select("metric", text.alias("label_text"), "value"))


def _exposition(spark, sf):
    return presented(exposition.exposition_lines(_metric_inputs(spark, sf)))


def _increase(spark, sf):
    snapshots = tables.counter_snapshots(spark, sf)
    return presented(counters.counter_increase(snapshots, ["event_type"], "seen_at", "value", 1800))


def _quantiles(spark, sf):
    histogram = delivery.latency_histogram(tables.delivery_attempts(spark, sf), groups=("channel_target",))
    return presented(counters.histogram_quantile(histogram, ["channel_target"], 0.95).withColumn(
        "quantile", F.round("quantile", 6)))


def _sustained(spark, sf):
    """Hours in which a channel received more than two waiting items, held for two hours."""
    waiting = tables.outbox(spark, sf).where(F.col("status").isin(*delivery.PENDING))
    hourly = waiting.groupBy("channel_target", F.date_trunc("hour", "created_at").alias("seen_at")).agg(F.count("*").alias("n"))
    return presented(counters.sustained(hourly.withColumn("high", F.col("n") > 1), ["channel_target"], "seen_at", "high", 7200))


def _heartbeat(spark, sf):
    return presented(counters.heartbeat_age(_runs(spark, sf), ["source_name"], "created_at",
                                            datetime(2024, 1, 31, 0, 0, tzinfo=timezone.utc)))


def _experiments(spark, sf):
    rows = runlog.experiment_payload(tables.experiments(spark, sf))
    rows = rows.select("experiment_id", "status", F.col("train_period.start").alias("train_start"),
                       F.col("validation_period.end").alias("validation_end"), "created_at")
    return presented(grid.latest_first(rows, "created_at", "experiment_id", limit=1000))


RUN_COUNTS_SQL = """COUNT(*) AS total_runs, COUNT(*) FILTER (final_status = 'PASS') AS pass_count,
    COUNT(*) FILTER (final_status = 'WARN') AS warn_count, COUNT(*) FILTER (final_status = 'FAIL') AS fail_count,
    COUNT(*) FILTER (blocked) AS blocked_count, COUNT(*) FILTER (used_unified) AS used_unified_count,
    COUNT(*) FILTER (used_unified) / COUNT(*) AS used_unified_rate"""
TREND_SQL = """COUNT(*) FILTER (final_status = 'PASS') AS pass_count,
    COUNT(*) FILTER (final_status = 'WARN') AS warn_count, COUNT(*) FILTER (final_status = 'FAIL') AS fail_count,
    COUNT(*) FILTER (blocked) AS blocked_count FROM run_log GROUP BY 1"""
RULES_SQL = f"""COUNT(*) FILTER (status = 'WARN') AS warn_count, COUNT(*) FILTER (status = 'FAIL') AS fail_count,
    {TS.format('MAX(created_at)')} AS last_seen_at,
    arg_max(message, created_at) AS sample_message FROM rule_log WHERE status IN ('WARN', 'FAIL')"""
ATTEMPT_SQL = """COUNT(*) FILTER (attempt_status = 'SENT') AS sent_count,
    COUNT(*) FILTER (attempt_status = 'RETRY') AS retry_count,
    COUNT(*) FILTER (attempt_status = 'DEAD') AS dead_count,
    COUNT(*) FILTER (replayed_from_id IS NOT NULL) AS replay_count,
    CAST(SUM(duration_ms) AS DOUBLE) / NULLIF(COUNT(duration_ms), 0) AS avg_delivery_latency_ms"""
BUCKETS = delivery.LATENCY_BUCKETS_MS
HISTOGRAM_SQL = " UNION ALL ".join(
    [f"SELECT CAST({b} AS DOUBLE) AS le, COUNT(*) FILTER (duration_ms <= {b}) AS cumulative FROM attempts" for b in BUCKETS]
    + ["SELECT CAST('Infinity' AS DOUBLE), COUNT(duration_ms) FROM attempts"])
MICROS = "CAST(epoch_us({}) AS BIGINT)"
METRICS_SQL = f"""
WITH w AS (SELECT * FROM outbox WHERE status IN ('PENDING', 'RETRYING')),
m AS (
  SELECT 'preflight_runs_total' AS metric, 'final_status=' || final_status || ',mode=' || mode || ',source_name=' || source_name AS label_text, CAST(COUNT(*) AS DOUBLE) AS value FROM run_log GROUP BY final_status, mode, source_name
  UNION ALL SELECT 'preflight_blocked_total', 'source_name=' || source_name, COUNT(*) FROM run_log WHERE blocked GROUP BY source_name
  UNION ALL SELECT 'preflight_latest_run_timestamp_seconds', 'source_name=' || source_name, epoch_us(MAX(created_at)) // 1000000 FROM run_log GROUP BY source_name
  UNION ALL SELECT 'preflight_alerts_active', 'severity=' || severity || ',status=' || status, COUNT(*) FROM alert_items GROUP BY severity, status
  UNION ALL SELECT 'preflight_alert_transitions_total', 'event_type=' || status, COUNT(*) FROM alert_items GROUP BY status
  UNION ALL SELECT 'preflight_alert_silences_active', '', COUNT(*) FROM silences WHERE expired_at IS NULL AND starts_at <= TIMESTAMP '2000-06-01' AND ends_at > TIMESTAMP '2000-06-01'
  UNION ALL SELECT 'preflight_notifications_attempts_total', 'attempt_status=' || attempt_status || ',channel_target=' || channel_target || ',event_type=' || event_type, COUNT(*) FROM attempts GROUP BY attempt_status, channel_target, event_type
  UNION ALL SELECT 'preflight_notifications_delivery_latency_ms_bucket', 'le=' || CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(CAST(le AS BIGINT) AS VARCHAR) END, cumulative FROM ({HISTOGRAM_SQL})
  UNION ALL SELECT 'preflight_notifications_delivery_latency_ms_sum', '', SUM(duration_ms) FROM attempts
  UNION ALL SELECT 'preflight_notifications_delivery_latency_ms_count', '', COUNT(duration_ms) FROM attempts
  UNION ALL SELECT 'preflight_notifications_outbox_pending', '', COUNT(*) FROM w
  UNION ALL SELECT 'preflight_notifications_outbox_dead', '', COUNT(*) FILTER (status = 'DEAD') FROM outbox
  UNION ALL SELECT 'preflight_notifications_replays_total', '', COUNT(replayed_from_id) FROM outbox
  UNION ALL SELECT 'preflight_notifications_outbox_oldest_pending_age_seconds', '', greatest(epoch_us(TIMESTAMP '2000-06-01') // 1000000 - epoch_us(MIN(created_at)) // 1000000, 0) FROM w
  UNION ALL SELECT 'preflight_notifications_dispatch_errors_total', '', COUNT(*) FILTER (attempt_status <> 'SENT') FROM attempts)
"""
METRIC_TABLES = "run_log alert_items silences attempts outbox"

QUERIES = [
    Query("run_filter", "P-12 P-13", _filtered, oracle("run_log", f"""
        SELECT run_id, {TS.format('created_at')} AS created_at, data_source_id, blocked FROM run_log
        WHERE source_name = 'train' AND mode = 'enforce' AND final_status = 'FAIL' AND {WINDOW_SQL}""")),
    Query("run_stats", "A-13", lambda s, d: presented(runlog.run_stats(_runs(s, d))), oracle("run_log", f"""
        SELECT source_name AS source, {RUN_COUNTS_SQL} FROM run_log GROUP BY 1
        UNION ALL SELECT NULL, {RUN_COUNTS_SQL} FROM run_log""")),
    Query("run_trends_day", "A-14 F-6", lambda s, d: presented(runlog.run_trends(_runs(s, d), "day")),
          oracle("run_log", f"SELECT {TS.format(chr(40) + 'date_trunc(' + repr('day') + ', created_at)' + chr(41) + '::TIMESTAMP')} AS bucket_start, {TREND_SQL}")),
    Query("run_trends_hour", "A-14 F-6", lambda s, d: presented(runlog.run_trends(_runs(s, d), "hour")),
          oracle("run_log", f"SELECT {TS.format(chr(40) + 'date_trunc(' + repr('hour') + ', created_at)' + chr(41) + '::TIMESTAMP')} AS bucket_start, {TREND_SQL}")),
    Query("semantic_reports", "S-9 F-20 F-17", _reports, oracle("run_log", """
        SELECT run_id, final_status AS status, CAST(2 AS BIGINT) AS total,
               CAST(final_status = 'PASS' AS BIGINT) + CAST(k % 5 <> 0 AS BIGINT) AS passed,
               CAST(final_status = 'WARN' AS BIGINT) + CAST(k % 5 = 0 AS BIGINT) AS warned,
               CAST(final_status = 'FAIL' AS BIGINT) AS failed FROM run_log WHERE k % 4 < 3""")),
    Query("top_rules", "A-15 T-2", lambda s, d: presented(runlog.top_rules(_events(s, d), 10)), oracle("rule_log", f"""
        SELECT rule_id, rule_type, severity, {RULES_SQL} GROUP BY rule_id, rule_type, severity
        ORDER BY fail_count DESC, warn_count DESC, last_seen_at DESC, rule_id DESC LIMIT 10""")),
    Query("rule_counts", "A-16 J-13", lambda s, d: presented(runlog.rule_counts(_events(s, d), ("rule_id",))),
          oracle("rule_log", f"SELECT rule_id, {RULES_SQL} GROUP BY rule_id")),
    Query("run_rollup_status", "A-34 Q-20", lambda s, d: presented(runlog.run_rollup(tables.grouped_run_log(s, d))),
          oracle("run_log", f"""
        SELECT run_id // 4 AS run_id, {TS.format('MIN(created_at)')} AS created_at,
               CASE WHEN bool_or(final_status = 'FAIL') THEN 'FAIL' WHEN bool_or(final_status = 'WARN') THEN 'WARN'
                    ELSE 'PASS' END AS final_status, bool_or(blocked) AS blocked, COUNT(*) AS sources
        FROM run_log GROUP BY 1""")),
    Query("latest_run_per_source", "L-4", lambda s, d: presented(runlog.latest_runs(_runs(s, d), "source_name")),
          oracle("run_log", f"""
        SELECT run_id, source_name, {TS.format('created_at')} AS created_at, mode, final_status, blocked, used_unified,
               data_source_id, CAST(k AS BIGINT) AS k FROM run_log
        QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY run_log.created_at DESC, run_id DESC) = 1""")),
    Query("source_health", "J-7 X-10", lambda s, d: presented(
        runlog.sources_with_health(tables.data_sources(s, d), _runs(s, d))), oracle("run_log data_sources", f"""
        WITH l AS (SELECT * FROM run_log
                   QUALIFY row_number() OVER (PARTITION BY data_source_id ORDER BY created_at DESC, run_id DESC) = 1)
        SELECT CAST(id AS BIGINT) AS id, name, is_default, is_active, final_status AS last_preflight_status,
               {TS.format('created_at')} AS last_preflight_at, run_id AS last_preflight_run_id
        FROM data_sources LEFT JOIN l ON l.data_source_id = id""")),
    Query("active_sources", "T-8", lambda s, d: presented(
        runlog.ordered_sources(tables.data_sources(s, d), include_inactive=False)), oracle("data_sources", """
        SELECT CAST(id AS BIGINT) AS id, name, is_default, is_active FROM data_sources WHERE is_active""")),
    Query("run_metrics", "A-18", lambda s, d: presented(runlog.run_metrics(_runs(s, d))), oracle("run_log", f"""
        SELECT source_name, final_status, mode, COUNT(*) AS runs, COUNT(*) FILTER (blocked) AS blocked_runs,
               {TS.format('MAX(created_at)')} AS latest_at FROM run_log GROUP BY source_name, final_status, mode""")),
    Query("latest_runs_page", "T-3", _latest_page, oracle("run_log", f"""
        SELECT run_id, source_name, {TS.format('created_at')} AS created_at, final_status FROM run_log
        ORDER BY run_log.created_at DESC, run_id DESC LIMIT 2000""")),
    Query("iso_timestamps", "F-19", _iso, oracle("run_log", """
        SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day, COUNT(*) AS num_rows, COUNT(*) AS same
        FROM run_log GROUP BY 1""")),
    Query("run_upsert", "K-2 K-3 M-17 M-11", _upsert, oracle("run_log", f"""
        SELECT run_id, {TS.format('created_at')} AS created_at,
               CASE WHEN run_id % 5 <> 0 THEN final_status ELSE 'RUNNING' END AS status FROM run_log""")),
    Query("experiment_list", "M-11 P-20 T-3", _experiments, f"""
        SELECT o_orderkey AS experiment_id,
               CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
               strftime(CAST(o_orderdate AS DATE) - 900, '%Y-%m-%d') AS train_start,
               strftime(o_orderdate, '%Y-%m-%d') AS validation_end, {TS.format('o_orderdate')} AS created_at
        FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000"""),
    Query("experiment_drift", "M-12", lambda s, d: presented(runlog.experiment_drift(tables.experiments(s, d))), """
        WITH c AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders
                   WHERE o_orderstatus = 'F'),
        p AS (SELECT a.o_orderkey AS latest_id, b.o_orderkey AS previous_id, a.o_totalprice AS ap, b.o_totalprice AS bp,
                     a.o_custkey AS ac, b.o_custkey AS bc FROM c a JOIN c b ON a.r = 1 AND b.r = 2),
        v AS (SELECT latest_id, previous_id, 'MAE' AS metric, ap AS x, bp AS y FROM p
              UNION ALL SELECT latest_id, previous_id, 'RMSE', ap * 2, bp * 2 FROM p
              UNION ALL SELECT latest_id, previous_id, 'WAPE', CAST(ac + 1 AS DOUBLE), CAST(bc + 1 AS DOUBLE) FROM p
              UNION ALL SELECT latest_id, previous_id, 'MAPE', CAST(latest_id + 1 AS DOUBLE), CAST(previous_id + 1 AS DOUBLE) FROM p),
        d AS (SELECT *, (x - y) / greatest(abs(y), 1e-8) * 100 AS delta FROM v)
        SELECT latest_id, previous_id, metric, ROUND(x, 4) AS current, ROUND(y, 4) AS previous,
               ROUND(delta, 2) AS delta_pct,
               CASE WHEN abs(delta) <= 3 THEN 'stable' WHEN delta > 0 THEN 'degrading' ELSE 'improving' END AS drift_status
        FROM d"""),
    Query("experiment_overall_drift", "M-12 X-11", lambda s, d: presented(
        runlog.overall_drift(runlog.experiment_drift(tables.experiments(s, d)))), """
        WITH c AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders
                   WHERE o_orderstatus = 'F'),
        v AS (SELECT unnest([a.o_totalprice, a.o_totalprice * 2, a.o_custkey + 1.0, a.o_orderkey + 1.0]) AS x,
                     unnest([b.o_totalprice, b.o_totalprice * 2, b.o_custkey + 1.0, b.o_orderkey + 1.0]) AS y
              FROM c a JOIN c b ON a.r = 1 AND b.r = 2),
        d AS (SELECT (x - y) / greatest(abs(y), 1e-8) * 100 AS delta FROM v)
        SELECT CASE WHEN COUNT(*) FILTER (delta > 3) > 0 THEN 'degrading'
                    WHEN COUNT(*) > 0 AND COUNT(*) FILTER (delta < -3) = COUNT(*) THEN 'improving' ELSE 'stable' END
               AS overall_drift FROM d"""),
    Query("outbox_filter", "P-14", _filtered_outbox, oracle("outbox", f"""
        SELECT id, channel_target, status, {TS.format('next_retry_at')} AS next_retry_at FROM outbox
        WHERE status IN ('PENDING', 'RETRYING') AND event_type = 'ALERT_FIRING'
          AND {WINDOW_SQL.replace('created_at', 'outbox.next_retry_at')}""")),
    Query("attempt_filter", "P-15", _filtered_attempts, oracle("attempts", f"""
        SELECT attempt_id, channel_target, {TS.format('started_at')} AS started_at FROM attempts
        WHERE attempt_status = 'RETRY' AND event_type = 'ALERT_RESOLVED'
          AND {WINDOW_SQL.replace('created_at', 'attempts.started_at')}""")),
    Query("newest_attempts", "T-5", _newest_attempts, oracle("attempts", f"""
        SELECT attempt_id, channel_target, attempt_status, {TS.format('started_at')} AS started_at FROM attempts
        ORDER BY attempts.started_at DESC, attempt_id DESC LIMIT 500""")),
    Query("deliveries_page", "T-4", _deliveries_page, oracle("outbox", f"""
        SELECT id, channel_target, {TS.format('created_at')} AS created_at, COUNT(*) OVER () AS total FROM outbox
        WHERE status = 'DEAD' ORDER BY outbox.created_at DESC, id DESC LIMIT 200 OFFSET 400""")),
    Query("deliveries_after", "T-4", _deliveries_after, oracle("outbox", f"""
        SELECT o.id, channel_target, {TS.format('o.created_at')} AS created_at,
               (SELECT COUNT(*) FROM outbox WHERE status = 'DEAD') AS total FROM outbox o
        WHERE status = 'DEAD' AND (o.created_at < TIMESTAMP '{PAGE_FROM:%Y-%m-%d %H:%M:%S}' OR
              o.created_at = TIMESTAMP '{PAGE_FROM:%Y-%m-%d %H:%M:%S}' AND o.id < {LAST_ID!r})
        ORDER BY o.created_at DESC, o.id DESC LIMIT 200""")),
    Query("due_items", "P-16", _due, oracle("outbox", f"""
        SELECT id, status, {TS.format('next_retry_at')} AS next_retry_at FROM outbox
        WHERE status IN ('PENDING', 'RETRYING') AND outbox.next_retry_at <= TIMESTAMP '2024-01-31 12:00:00'""")),
    Query("delivery_stats", "A-19 F-24", lambda s, d: presented(
        delivery.delivery_stats(tables.delivery_attempts(s, d), tables.outbox(s, d), NOW).withColumn(
            "p95_delivery_latency_ms", F.round("p95_delivery_latency_ms", 4))), oracle("attempts outbox", f"""
        WITH w AS (SELECT COUNT(*) AS n, MIN(created_at) AS oldest FROM outbox WHERE status IN ('PENDING', 'RETRYING'))
        SELECT COUNT(*) AS total_events, {ATTEMPT_SQL},
               ROUND(quantile_cont(CAST(duration_ms AS DOUBLE), 0.95), 4) AS p95_delivery_latency_ms,
               (SELECT n FROM w) AS pending_count,
               (SELECT greatest(({MICROS.format("TIMESTAMP '2024-01-31 12:00:00'")} - {MICROS.format('oldest')}) // 1000000, 0) FROM w)
                 AS oldest_pending_age_seconds,
               COUNT(*) FILTER (attempt_status = 'SENT') / COUNT(*) FILTER (attempt_status IN ('SENT', 'DEAD', 'FAILED'))
                 AS success_rate FROM attempts""")),
    Query("delivery_trends", "A-20", lambda s, d: presented(
        delivery.delivery_trends(tables.delivery_attempts(s, d), "day")), oracle("attempts", f"""
        SELECT {TS.format("CAST(date_trunc('day', started_at) AS TIMESTAMP)")} AS bucket_start, {ATTEMPT_SQL}
        FROM attempts GROUP BY 1""")),
    Query("channel_summary", "A-21 J-14 X-12", lambda s, d: presented(
        delivery.channel_summary(tables.delivery_attempts(s, d), tables.outbox(s, d))), oracle("attempts outbox", f"""
        WITH a AS (SELECT channel_target, {ATTEMPT_SQL},
                          MAX(CASE WHEN attempt_status = 'SENT' THEN completed_at END) AS ls,
                          MAX(CASE WHEN error_code IS NOT NULL THEN completed_at END) AS le FROM attempts GROUP BY 1),
        w AS (SELECT channel_target, COUNT(*) AS pending_count FROM outbox
              WHERE status IN ('PENDING', 'RETRYING') GROUP BY 1),
        c AS (SELECT channel_target, error_code, COUNT(*) AS n FROM attempts WHERE error_code IS NOT NULL GROUP BY 1, 2
              QUALIFY row_number() OVER (PARTITION BY channel_target ORDER BY COUNT(*) DESC, error_code) <= 5),
        t AS (SELECT channel_target, string_agg(error_code || '=' || n, ',' ORDER BY n DESC, error_code) AS codes
              FROM c GROUP BY 1)
        SELECT COALESCE(a.channel_target, w.channel_target) AS channel_target, COALESCE(sent_count, 0) AS sent_count,
               COALESCE(retry_count, 0) AS retry_count, COALESCE(dead_count, 0) AS dead_count,
               COALESCE(replay_count, 0) AS replay_count, avg_delivery_latency_ms, {TS.format('ls')} AS last_sent_at,
               {TS.format('le')} AS last_error_at, COALESCE(pending_count, 0) AS pending_count,
               codes AS top_error_codes,
               CASE WHEN COALESCE(sent_count + dead_count, 0) > 0 THEN sent_count / (sent_count + dead_count) ELSE 0.0 END
                 AS success_rate
        FROM a FULL JOIN w ON w.channel_target = a.channel_target LEFT JOIN t ON t.channel_target = a.channel_target""")),
    Query("attempt_metrics", "A-22", lambda s, d: presented(delivery.attempt_metrics(tables.delivery_attempts(s, d))),
          oracle("attempts", """
        SELECT channel_target, event_type, attempt_status, COUNT(*) AS attempts FROM attempts GROUP BY 1, 2, 3""")),
    Query("latency_histogram", "A-22", lambda s, d: presented(delivery.latency_histogram(tables.delivery_attempts(s, d))),
          oracle("attempts", f"""
        SELECT h.*, CAST((SELECT SUM(duration_ms) FROM attempts) AS BIGINT) AS latency_sum_ms,
               (SELECT COUNT(duration_ms) FROM attempts) AS latency_count FROM ({HISTOGRAM_SQL}) h""")),
    Query("outbox_counts", "A-23", lambda s, d: presented(delivery.outbox_counts(tables.outbox(s, d))), oracle("outbox", f"""
        SELECT COUNT(*) FILTER (status IN ('PENDING', 'RETRYING')) AS pending_count,
               COUNT(*) FILTER (status = 'DEAD') AS dead_count, COUNT(replayed_from_id) AS replayed_count,
               {TS.format("MIN(CASE WHEN status IN ('PENDING', 'RETRYING') THEN created_at END)")} AS oldest_pending_at
        FROM outbox""")),
    Query("metric_table", "A-24 A-25 U-1", _metric_table, oracle(METRIC_TABLES, METRICS_SQL + "SELECT * FROM m")),
    Query("metric_exposition", "K-7", _exposition, oracle(METRIC_TABLES, METRICS_SQL + """
        SELECT metric, metric || CASE WHEN label_text = '' THEN '' ELSE
               '{' || regexp_replace(label_text, '=([^,]*)', '="\\1"', 'g') || '}' END
               || ' ' || CAST(CAST(value AS BIGINT) AS VARCHAR) AS line FROM m""")),
    Query("delivery_outcomes", "R-5 F-14 F-15 F-16", _dispatch, oracle("outbox results", f"""
        WITH i AS (SELECT o.*, r.success, r.http_status, r.error_code, r.error,
                          o.channel_target IN ('channel_0', 'channel_1', 'channel_2', 'channel_3') AS known,
                          o.channel_target <> 'channel_3' AS has_target, attempt_count + 1 AS attempt,
                          CASE o.channel_target WHEN 'channel_1' THEN 60 WHEN 'channel_2' THEN 7200 ELSE 30 END AS backoff
                   FROM outbox o LEFT JOIN results r ON r.id = o.id WHERE o.status IN ('PENDING', 'RETRYING')),
        s AS (SELECT *, CASE WHEN NOT known OR NOT has_target THEN 'DEAD' WHEN COALESCE(success, FALSE) THEN 'SENT'
                             WHEN (http_status IS NULL OR http_status IN (408, 429) OR http_status >= 500)
                                  AND attempt < max_attempts THEN 'RETRYING' ELSE 'DEAD' END AS st FROM i)
        SELECT id, channel_target, event_type, CAST(attempt AS BIGINT) AS attempt_count, st AS status,
               CASE WHEN known AND has_target THEN CAST(http_status AS BIGINT) END AS last_http_status,
               CASE WHEN NOT known THEN 'CHANNEL_UNAVAILABLE' WHEN NOT has_target THEN 'CHANNEL_TARGET_MISSING'
                    WHEN NOT COALESCE(success, FALSE) THEN COALESCE(error_code, 'UNEXPECTED_ERROR') END AS last_error_code,
               CASE WHEN NOT COALESCE(success, FALSE) THEN error END AS last_error,
               CASE WHEN st = 'RETRYING' THEN {TS.format("TIMESTAMP '2024-01-31 12:00:00' + to_seconds(least(backoff * pow(2, attempt - 1), 86400)::BIGINT)")} END
                 AS next_retry_at,
               CASE WHEN st = 'SENT' THEN '2024-01-31 12:00:00.000000' END AS sent_at FROM s""")),
    Query("replay_dead", "R-6", _replayed, oracle("outbox", """
        WITH h AS (SELECT *, sha256(id || '|2024-01-31T12:00:00+00:00') AS x FROM outbox
                   WHERE status IN ('DEAD', 'FAILED', 'SENT'))
        SELECT substr(x, 1, 32) AS new_id, event_id, substr(x, 33, 32) AS delivery_id, id AS replayed_from_id,
               channel_target, event_type, 'PENDING' AS status, CAST(0 AS BIGINT) AS attempt_count, CAST(max_attempts AS BIGINT) AS max_attempts,
               '2024-01-31 12:00:00.000000' AS next_retry_at, '2024-01-31 12:00:00.000000' AS created_at FROM h""")),
    Query("attempt_durations", "R-8 F-24", _durations, oracle("attempts", f"""
        SELECT attempt_id, {TS.format('started_at')} AS started_at,
               CASE WHEN k % 13 <> 0 THEN {TS.format('completed_at')} END AS completed_at,
               CASE WHEN k % 13 <> 0 THEN attempt_status ELSE 'STARTED' END AS attempt_status,
               CASE WHEN k % 13 <> 0 THEN CAST(COALESCE(duration_ms, 0) AS BIGINT)
                    ELSE NULL END AS duration_ms FROM attempts""")),
    Query("counter_increase", "R-9", _increase, oracle("snapshots", f"""
        WITH g AS (SELECT *, epoch_us(seen_at) // 1000000 AS sec, LAG(value) OVER (PARTITION BY event_type ORDER BY seen_at) AS b
                   FROM snapshots),
        r AS (SELECT *, SUM(CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END)
                        OVER (PARTITION BY event_type ORDER BY sec) AS run FROM g),
        i AS (SELECT *, CAST(run - MIN(run) OVER (PARTITION BY event_type ORDER BY sec
                        RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW) AS BIGINT) AS increase FROM r)
        SELECT event_type, {TS.format('seen_at')} AS seen_at, value, increase, increase / 1800.0::DOUBLE AS rate FROM i""")),
    Query("histogram_quantile", "R-10", _quantiles, oracle("attempts", """
        WITH b(le) AS (VALUES (50.0::DOUBLE), (100), (250), (500), (1000), (2500), (5000), (10000), (30000), (60000),
                              ('Infinity'::DOUBLE)),
        h AS (SELECT channel_target, le, COUNT(*) FILTER (duration_ms <= le) AS c FROM attempts, b GROUP BY 1, 2),
        w AS (SELECT *, COALESCE(LAG(c) OVER o, 0) AS below, COALESCE(LAG(le) OVER o, 0) AS low,
                     0.95::DOUBLE * MAX(c) OVER (PARTITION BY channel_target) AS rank
              FROM h WINDOW o AS (PARTITION BY channel_target ORDER BY le))
        SELECT channel_target, ROUND(arg_min(CASE WHEN isinf(le) THEN low
                   ELSE low + (le - low) * ((rank - below) / (c - below)) END, le), 6) AS quantile
        FROM w WHERE rank > 0 AND c >= rank GROUP BY 1""")),
    Query("sustained_condition", "R-11", _sustained, oracle("outbox", f"""
        WITH n AS (SELECT channel_target, date_trunc('hour', created_at) AS seen_at, COUNT(*) AS n, COUNT(*) > 1 AS high
                   FROM outbox WHERE status IN ('PENDING', 'RETRYING') GROUP BY 1, 2),
        i AS (SELECT *, SUM(CASE WHEN high THEN 0 ELSE 1 END) OVER (PARTITION BY channel_target ORDER BY seen_at) AS isl FROM n),
        s AS (SELECT *, CASE WHEN high THEN MIN(CASE WHEN high THEN seen_at END)
                        OVER (PARTITION BY channel_target, isl ORDER BY seen_at) END AS since FROM i)
        SELECT channel_target, {TS.format('seen_at::TIMESTAMP')} AS seen_at, n, high, {TS.format('since::TIMESTAMP')} AS active_since,
               CASE WHEN NOT high THEN 'inactive' WHEN epoch(seen_at) - epoch(since) >= 7200 THEN 'firing' ELSE 'pending' END
                 AS state FROM s""")),
    Query("heartbeat_age", "R-11", _heartbeat, oracle("run_log", f"""
        SELECT source_name, {TS.format('MAX(created_at)')} AS last_tick,
               (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(MAX(created_at))) // 1000000 AS age_seconds,
               (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(MAX(created_at))) // 1000000 > 180 AS is_stale
        FROM run_log GROUP BY source_name""")),
]
