"""Run-log, delivery and alert results on seeded rows with known answers."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from shelfscope.functions.windows import resolve_window
from shelfscope.operators import alerts, counters, delivery, exposition, runlog
from shelfscope.operators.keyed import latest_per_key
from shelfscope.operators.percentile import exact_percentile
from shelfscope.plans.quality_queries import CONFIG
from shelfscope.sources import tables
from shelfscope.sources.policies import Policy, load_channels, load_policies, policy_frame

UTC = timezone.utc


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


@pytest.fixture(scope="module")
def runs(spark):
    import json

    def report(*rules):
        return json.dumps({"status": None, "rules": [
            {"rule_id": i, "rule_type": t, "severity": s, "status": st, "message": f"{i} bad"} for i, t, s, st in rules]})

    day = ("day_of_week_allowed", "accepted_values", "FAIL", "FAIL")
    nulls = ("customers_null_ratio", "max_null_ratio", "WARN", "WARN")
    unique = ("store_pk_unique", "composite_unique", "FAIL", "FAIL")
    rows = [
        ("run_001", "train", at("2026-02-20 10:00"), "report_only", "PASS", False, False, 1, report(), None, None),
        ("run_002", "train", at("2026-02-21 11:00"), "enforce", "WARN", False, True, 1, report(nulls), None, None),
        ("run_003", "store", at("2026-02-21 12:00"), "enforce", "FAIL", True, True, 2, None,
         json.dumps({"semantic_quality": json.loads(report(unique))}), None),
        ("run_004", "train", at("2026-02-22 09:30"), "report_only", "FAIL", False, True, None, "{broken", None,
         json.dumps({"semantic": json.loads(report(day))})),
    ]
    return spark.createDataFrame(rows, (
        "run_id string, source_name string, created_at timestamp, mode string, final_status string, blocked boolean, "
        "used_unified boolean, data_source_id int, semantic_json string, manifest_json string, preflight_json string"))


def test_run_stats_and_trends(runs):
    stats = {r["source"]: r for r in runlog.run_stats(runs).collect()}
    total = stats[None]
    assert [total[c] for c in ("total_runs", "pass_count", "warn_count", "fail_count", "blocked_count", "used_unified_count")] == [4, 1, 1, 2, 1, 3]
    assert total["used_unified_rate"] == 0.75
    assert stats["train"]["total_runs"] == 3 and stats["store"]["total_runs"] == 1
    days = {str(r["bucket_start"])[:10]: r for r in runlog.run_trends(runs, "day").collect()}
    assert len(days) == 3
    d = days["2026-02-21"]
    assert (d["pass_count"], d["warn_count"], d["fail_count"], d["blocked_count"]) == (0, 1, 1, 1)
    with pytest.raises(ValueError):
        runlog.run_trends(runs, "week")


def test_rules_and_fallback(runs):
    top = {r["rule_id"]: r for r in runlog.top_rules(runlog.rule_events(runs)).collect()}
    assert {k: (r["warn_count"], r["fail_count"]) for k, r in top.items()} == {
        "customers_null_ratio": (1, 0), "store_pk_unique": (0, 1), "day_of_week_allowed": (0, 1)}
    assert top["day_of_week_allowed"]["sample_message"] == "day_of_week_allowed bad"
    first = runlog.top_rules(runlog.rule_events(runs)).first()
    assert first["rule_id"] == "day_of_week_allowed"  # same counts, seen later
    seen = {r["run_id"]: (r["status"], r["total"], r["failed"]) for r in runlog.semantic_overview(runs).collect()}
    assert seen == {"run_001": ("PASS", 0, 0), "run_002": ("WARN", 1, 0), "run_003": ("FAIL", 1, 1), "run_004": ("FAIL", 1, 1)}


def test_filters_and_windows(runs):
    window = resolve_window("2026-02-21", "2026-02-21")
    assert runlog.filtered_runs(runs, window=window).count() == 2
    assert runlog.filtered_runs(runs, source_name="train", final_status=" fail ").count() == 1
    assert resolve_window(days=2, now=at("2026-02-22 00:00")) == (at("2026-02-20 00:00"), at("2026-02-22 00:00"))
    assert resolve_window() == (None, None)
    assert resolve_window(None, "2026-01-01T01:00:00+02:00")[1] == at("2025-12-31 23:00")
    for bad in ({"days": 0}, {"days": 1, "date_from": "2026-01-01"}, {"date_from": "x"}, {"date_from": "2026-02-01", "date_to": "2026-01-01"}):
        with pytest.raises(ValueError):
            resolve_window(**bad)


def test_latest_rollup_and_health(spark, runs):
    assert {r["run_id"] for r in runlog.latest_runs(runs, "source_name").collect()} == {"run_004", "run_003"}
    sources = spark.createDataFrame([(1, "a", True, True), (2, "b", False, False), (3, "c", False, True)], "id int, name string, is_default boolean, is_active boolean")
    health = {r["id"]: r["last_preflight_status"] for r in runlog.sources_with_health(sources, runs).collect()}
    assert health == {1: "WARN", 2: "FAIL", 3: None}
    assert [r["id"] for r in runlog.ordered_sources(sources, include_inactive=False).collect()] == [1, 3]
    grouped = runs.withColumn("run_id", F.substring("run_id", 1, 6))
    row = runlog.run_rollup(grouped).first()
    assert row["final_status"] == "FAIL" and row["blocked"] and row["sources"] == 4


def test_latest_per_key_with_a_hot_key(spark):
    rows = spark.range(90000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    got = latest_per_key(rows, ["k"], ["v"])
    assert got.where("k = 7").first()["v"] == 89999 and got.count() == 30001 - 0


def test_drift(spark):
    import json

    def exp(i, status, day, **best):
        return (i, status, at(f"2026-01-0{day} 00:00"), json.dumps({"best": best}))

    schema = "experiment_id string, status string, created_at timestamp, metrics_json string"
    rows = [exp("a", "COMPLETED", 1, mae=100.0, rmse=200.0), exp("b", "completed", 2, mae=90.0, rmse=202.0), exp("c", "FAILED", 3, mae=1.0)]
    df = spark.createDataFrame(rows, schema)
    drift = {r["metric"]: (r["delta_pct"], r["drift_status"]) for r in runlog.experiment_drift(df).collect()}
    assert drift == {"MAE": (-10.0, "improving"), "RMSE": (1.0, "stable")}
    assert runlog.overall_drift(runlog.experiment_drift(df)).first()[0] == "stable"
    none = runlog.experiment_drift(df.where("experiment_id = 'a'"))
    assert none.count() == 0 and runlog.overall_drift(none).first()[0] == "stable"


# Deliveries ------------------------------------------------------------------------------------------

ATTEMPT = (
    "attempt_id int, channel_target string, event_type string, started_at timestamp, completed_at timestamp, attempt_status string, "
    "duration_ms int, http_status int, error_code string, replayed_from_id string"
)


@pytest.fixture(scope="module")
def attempts(spark):
    rows = [
        (1, "channel_a", "ALERT_FIRING", "2026-02-20 10:00", "SENT", 5000, 204, None, None),
        (2, "channel_a", "ALERT_FIRING", "2026-02-20 12:00", "RETRY", 1500, 503, "HTTP_ERROR", None),
        (3, "channel_a", "ALERT_FIRING", "2026-02-20 12:02", "DEAD", 1000, 503, "HTTP_ERROR", None),
        (4, "channel_b", "ALERT_RESOLVED", "2026-02-21 09:00", "RETRY", 2000, None, "NETWORK_ERROR", None),
        (5, "channel_a", "ALERT_RESOLVED", "2026-02-22 09:00", "SENT", 1000, 204, None, "n2"),
    ]
    full = [(i, c, e, at(t), at(t) + timedelta(milliseconds=ms), s, ms, h, err, rep) for i, c, e, t, s, ms, h, err, rep in rows]
    return spark.createDataFrame(full, ATTEMPT)


@pytest.fixture(scope="module")
def outbox(spark):
    schema = (
        "id string, event_id string, channel_target string, event_type string, status string, attempt_count int, max_attempts int, "
        "next_retry_at timestamp, created_at timestamp, replayed_from_id string")
    t = at("2026-02-21 09:00")
    return spark.createDataFrame([("o1", "e1", "channel_b", "ALERT_RESOLVED", "RETRYING", 1, 5, t, t, None)], schema)


def test_delivery_stats(attempts, outbox):
    row = delivery.delivery_stats(attempts, outbox, at("2026-02-21 09:01")).first()
    assert (row["total_events"], row["sent_count"], row["dead_count"], row["retry_count"], row["replay_count"], row["pending_count"]) == (5, 2, 1, 2, 1, 1)
    assert row["success_rate"] == pytest.approx(2 / 3)
    assert row["avg_delivery_latency_ms"] == 2100 and row["p95_delivery_latency_ms"] == pytest.approx(4400)
    assert row["oldest_pending_age_seconds"] == 60
    empty = delivery.delivery_stats(attempts.where("false"), outbox.where("false"), at("2026-02-21 09:01")).first()
    assert (empty["total_events"], empty["success_rate"], empty["p95_delivery_latency_ms"], empty["oldest_pending_age_seconds"]) == (0, 0.0, None, None)


def test_channels(attempts, outbox):
    rows = {r["channel_target"]: r for r in delivery.channel_summary(attempts, outbox).collect()}
    a, b = rows["channel_a"], rows["channel_b"]
    assert a["avg_delivery_latency_ms"] == 2125 and a["top_error_codes"] == "HTTP_ERROR=2" and a["pending_count"] == 0
    assert b["pending_count"] == 1 and b["success_rate"] == 0.0 and a["success_rate"] == pytest.approx(2 / 3)
    assert delivery.filtered_attempts(attempts, status="retrying").count() == 2
    with pytest.raises(ValueError):
        delivery.filtered_attempts(attempts, status="SENT", attempt_status="SENT")


def test_histogram_and_quantile(attempts):
    rows = {r["le"]: r["cumulative"] for r in delivery.latency_histogram(attempts).collect()}
    assert rows[500.0] == 0 and rows[1000.0] == 2 and rows[2500.0] == 4 and rows[5000.0] == 5 and rows[float("inf")] == 5
    q = counters.histogram_quantile(delivery.latency_histogram(attempts).withColumn("s", F.lit("x")), ["s"], 0.95).first()
    assert q["quantile"] == pytest.approx(2500 + 2500 * (4.75 - 4) / 1)


def test_dispatch_and_replay(spark):
    schema = "id string, event_id string, channel_target string, event_type string, status string, attempt_count int, max_attempts int"
    items = spark.createDataFrame([
        ("ok", "e", "channel_0", "ALERT_FIRING", "PENDING", 0, 5), ("again", "e", "channel_1", "ALERT_FIRING", "RETRYING", 2, 5),
        ("used", "e", "channel_2", "ALERT_FIRING", "RETRYING", 2, 3), ("bad", "e", "channel_0", "ALERT_FIRING", "PENDING", 0, 5),
        ("gone", "e", "nowhere", "ALERT_FIRING", "PENDING", 0, 5), ("off", "e", "channel_4", "ALERT_FIRING", "PENDING", 0, 5),
        ("blank", "e", "channel_3", "ALERT_FIRING", "PENDING", 0, 5), ("lost", "e", "channel_0", "ALERT_FIRING", "PENDING", 0, 5)], schema)
    results = spark.createDataFrame([
        ("ok", True, 204, None, None), ("again", False, 503, "http_error", "HTTP\n503"), ("used", False, 429, "http_error", "x"),
        ("bad", False, 400, "http_error", "x")], "id string, success boolean, http_status int, error_code string, error string")
    now = at("2026-01-01 00:00")
    got = {r["id"]: r for r in delivery.dispatch_outcomes(items, results, load_channels(CONFIG / "channels.yaml"), now).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "ok": "SENT", "again": "RETRYING", "used": "DEAD", "bad": "DEAD", "gone": "DEAD", "off": "DEAD", "blank": "DEAD", "lost": "RETRYING"}
    assert got["gone"]["last_error_code"] == got["off"]["last_error_code"] == "CHANNEL_UNAVAILABLE"
    assert got["blank"]["last_error_code"] == "CHANNEL_TARGET_MISSING" and got["lost"]["last_error_code"] == "UNEXPECTED_ERROR"
    assert got["again"]["last_error"] == "HTTP 503" and got["again"]["attempt_count"] == 3
    assert got["again"]["next_retry_at"].replace(tzinfo=UTC) == now + timedelta(seconds=60 * 4)
    dead = items.withColumn("status", F.lit("DEAD"))
    copies = delivery.replayed(dead, now).collect()
    assert len({r["id"] for r in copies}) == 8 and {r["attempt_count"] for r in copies} == {0} and {r["event_id"] for r in copies} == {"e"}


def test_exposition_text(spark):
    rows = [("m", {"b": 'x"y', "a": "1\n"}, 2.5), ("n", {}, 3.0)]
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, value double")
    lines = {r["line"] for r in exposition.exposition_lines(df).collect()}
    assert lines == {'m{a="1\\n",b="x\\"y"} 2.5', "n 3"}


# Alerts ----------------------------------------------------------------------------------------------


def test_policy_file(spark):
    policies = load_policies(CONFIG / "alert_policies.yaml")
    assert len(policies) == 4 and policy_frame(spark, policies).count() == 4


def test_state_machine(spark):
    policy = Policy("p", "HIGH", "train", 7, "fail_count", ">", 0.0, 2)
    rows = [("run", "train", at("2026-01-01 10:00"), "FAIL", False, False), ("late", "train", at("2026-01-08 15:00"), "PASS", False, False)]
    log = spark.createDataFrame(rows, "run_id string, source_name string, created_at timestamp, final_status string, blocked boolean, used_unified boolean")
    none = spark.createDataFrame([], "run_id string, source_name string, created_at timestamp, rule_id string, status string")
    states = alerts.alert_states(alerts.alert_metrics(log, none, [policy]))
    history = [(r["status"], str(r["evaluated_at"])[5:16], r["consecutive_breaches"]) for r in alerts.alert_history(states).orderBy("evaluated_at").collect()]
    # The run lies exactly on a tick, so it still counts seven days later and resolves one tick after.
    assert history == [("PENDING", "01-01 10:00", 1), ("FIRING", "01-01 11:00", 2), ("RESOLVED", "01-08 11:00", 0)]
    events = [r["event_type"] for r in alerts.transitions(states).orderBy("evaluated_at").collect()]
    assert events == ["ALERT_FIRING", "ALERT_RESOLVED"]
    out = alerts.fan_out(alerts.transitions(states), load_channels(CONFIG / "channels.yaml"))
    assert sorted((r["event_type"], r["channel_target"]) for r in out.collect()) == [
        ("ALERT_FIRING", "channel_0"), ("ALERT_FIRING", "channel_1"), ("ALERT_FIRING", "channel_2"),
        ("ALERT_RESOLVED", "channel_0"), ("ALERT_RESOLVED", "channel_2")]
    assert out.select("event_id").distinct().count() == 2


def test_silences_and_acknowledgements(spark):
    items = spark.createDataFrame(
        [("a1", "p1", "train", "HIGH", None), ("a2", "p2", "store", "LOW", "r1"), ("a3", "p3", None, "LOW", None)],
        "alert_id string, policy_id string, source_name string, severity string, rule_id string")
    t = at("2026-01-01 00:00")
    silences = spark.createDataFrame([
        (1, None, " Train ", "high", "", t, t, t + timedelta(days=2), None), (2, "p1", None, None, None, t + timedelta(hours=1), t, t + timedelta(days=2), None),
        (3, None, None, "low", "r1", t, t, t + timedelta(days=2), None), (4, None, None, None, None, t, t, t + timedelta(hours=1), None)],
        "silence_id int, policy_id string, source_name string, severity string, rule_id string, created_at timestamp, starts_at timestamp, ends_at timestamp, expired_at timestamp")
    now = at("2026-01-02 00:00")
    active = alerts.active_silences(alerts.expired_silences(silences, now), now)
    assert active.count() == 3
    got = {r["alert_id"]: r["silence_id"] for r in alerts.with_silences(items, active).collect()}
    assert got == {"a1": 2, "a2": 3, "a3": None}
    commands = spark.createDataFrame([
        (1, "a1", "acknowledge", t, "x"), (2, "a2", "acknowledge", t, "x"), (3, "a2", "clear", t + timedelta(hours=1), "x")],
        "command_id int, alert_id string, command string, made_at timestamp, actor string")
    acked = alerts.with_acknowledgements(items, alerts.active_acknowledgements(commands))
    assert {r["alert_id"] for r in acked.where("is_acknowledged").collect()} == {"a1"}


# Percentiles -----------------------------------------------------------------------------------------


def test_exact_percentile_on_skewed_data(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        F.when(F.col("id") % 5 == 0, -7).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**9)) - 10**6).alias("v"))
    for p in (0.0, 0.5, 0.95, 0.997, 1.0):
        want = {r[0]: r[1] for r in df.groupBy("g").agg(F.percentile("v", p)).collect()}
        got = {r[0]: r[1] for r in exact_percentile(df, "v", p, ["g"]).collect()}
        assert got == pytest.approx(want)
        assert exact_percentile(df, "v", p).first()[0] == pytest.approx(df.agg(F.percentile("v", p)).first()[0])
    assert exact_percentile(df.where("false"), "v", 0.5).first()[0] is None
    assert exact_percentile(df.where("false"), "v", 0.5, ["g"]).count() == 0


def metric_inputs(spark, sf):
    items = tables.alert_items(spark, sf)
    audit = items.select("alert_id", F.col("status").alias("event_type"))
    return [tables.run_log(spark, sf), items, audit, tables.silences(spark, sf), tables.delivery_attempts(spark, sf), tables.outbox(spark, sf)]


def test_metric_table_reads_each_input_once(spark, sf):
    plan = exposition.metric_table(*metric_inputs(spark, sf), datetime(2000, 6, 1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == len(metric_inputs(spark, sf))


def test_metric_table_of_empty_inputs(spark, sf):
    empty = [t.where("false") for t in metric_inputs(spark, sf)]
    rows = {(r.metric.removeprefix("preflight_"), *r.labels.values()): r.value for r in exposition.metric_table(*empty, datetime(2000, 6, 1)).collect()}
    latency = "notifications_delivery_latency_ms"
    wanted = {(f"{latency}_bucket", str(b)) for b in delivery.LATENCY_BUCKETS_MS} | {(f"{latency}_bucket", "+Inf"), (f"{latency}_sum",), (f"{latency}_count",)}
    wanted |= {(f"notifications_{n}",) for n in ("outbox_pending", "outbox_dead", "replays_total", "outbox_oldest_pending_age_seconds", "dispatch_errors_total")}
    assert set(rows) == wanted | {("alert_silences_active",)} and set(rows.values()) == {0.0}
