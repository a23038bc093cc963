"""Streams against the batch answer over the same log."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import alerts
from shelfscope.sources.policies import Policy
from shelfscope.streaming.alerts import EVALUATION_SCHEMA, evaluation_stream, known_states, state_stream
from shelfscope.operators import delivery
from shelfscope.sources import tables
from shelfscope.streaming.deliveries import attempt_stream, delivery_stream, duration_stream, outcome_stream

RUNS = (
    "run_id long, source_name string, created_at timestamp, final_status string, blocked boolean, used_unified boolean, "
    "failed_rules array<string>"
)
POLICIES = [
    Policy("rate", "HIGH", "train", 1, "fail_rate", ">", 0.4, 2),
    Policy("count", "LOW", None, 1, "fail_count", ">=", 3.0, 1),
    Policy("rule", "LOW", "store", 1, "semantic_rule_fail_count", ">", 1.0, 1, "r1"),
    Policy("top", "LOW", None, 2, "top_rule_fail_count", ">", 2.0, 1),
    Policy("unified", "MEDIUM", None, 2, "unified_usage_rate", "<", 0.5, 3),
    Policy("off", "LOW", None, 1, "blocked_count", ">", 0.0, 1, enabled=False),
]
START = datetime(2024, 1, 1)


def run_rows():
    """Six days of runs, none exactly on a tick, with a quiet stretch."""
    rows = []
    for i in range(160):
        at = START + timedelta(minutes=37 * i + 7, seconds=5)
        if timedelta(hours=50) < at - START < timedelta(hours=80):
            continue
        fail = i % 5 == 0 or 30 < i < 50
        rows.append((
            i, "train" if i % 3 else "store", at, "FAIL" if fail else "PASS", i % 7 == 0, i % 4 < 2,
            ["r1", "r2"] if fail and i % 2 else ["r1"] if fail else []))
    return rows


def drain(stream, path, checkpoint):
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def test_evaluations_and_states_match_batch(spark, tmp_path):
    rows = run_rows()
    log = spark.createDataFrame(rows, RUNS)
    last = max(r[2] for r in rows)
    hours = int((last - START).total_seconds() // 3600) + 1
    # The clock runs on for four hours so that the watermark closes the last windows.
    ticks = [(START + timedelta(hours=h, minutes=30),) for h in range(hours + 4)]
    for part in range(4):
        chunk = [r for r in rows if int((r[2] - START).total_seconds() // 3600) * 4 // hours == part]
        spark.createDataFrame(chunk, RUNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "runs"))
        some = ticks[part * len(ticks) // 4: (part + 1) * len(ticks) // 4]
        spark.createDataFrame(some, "created_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))

    runs = spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "runs"))
    clock = spark.readStream.schema("created_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ticks"))
    drain(evaluation_stream(runs, clock, POLICIES), str(tmp_path / "evaluations"), str(tmp_path / "c1"))

    events = log.select("run_id", "source_name", "created_at", F.explode("failed_rules").alias("rule_id")).withColumn(
        "status", F.lit("FAIL"))
    batch = alerts.alert_metrics(log, events, POLICIES)
    expected = {(r["policy_id"], r["evaluated_at"]): (round(r["current_value"], 9), r["condition_met"]) for r in batch.collect()}
    found = spark.read.parquet(str(tmp_path / "evaluations"))
    got = {(r["policy_id"], r["evaluated_at"]): (round(r["current_value"], 9), r["condition_met"]) for r in found.collect()}
    assert {p for p, _ in got} == {"rate", "count", "rule", "top", "unified"}
    shared = set(expected) & set(got)
    assert shared == set(expected)
    assert {k: got[k] for k in shared} == {k: expected[k] for k in shared}

    # The state machine over the batch evaluations, streamed in time order.
    columns = [c.split()[0] for c in EVALUATION_SCHEMA.split(", ")]
    ordered = batch.select(*columns).orderBy("evaluated_at", "policy_id").collect()
    for i in range(4):
        part = ordered[i * len(ordered) // 4: (i + 1) * len(ordered) // 4]
        spark.createDataFrame(part, EVALUATION_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVALUATION_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(state_stream(stream), str(tmp_path / "states"), str(tmp_path / "c2"))
    keys = ["policy_id", "evaluated_at", "status", "previous_status", "consecutive_breaches", "first_seen_at"]
    streamed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "states")).select(*keys).collect()}
    states = alerts.alert_states(batch)
    assert streamed == {tuple(r) for r in states.select(*keys).collect()}
    sent = spark.read.parquet(str(tmp_path / "states")).where("event_type IS NOT NULL")
    assert {tuple(r) for r in sent.select("policy_id", "evaluated_at", "event_type").collect()} == {
        tuple(r) for r in alerts.transitions(states).select("policy_id", "evaluated_at", "event_type").collect()}
    assert {"PENDING", "FIRING", "RESOLVED", "OK"} <= {s[2] for s in streamed}


@pytest.mark.parametrize("cut, again", [(0, 0), (2, 0), (7, 3), (11, 11)])
def test_states_go_on_from_a_log(spark, tmp_path, cut, again):
    """Batch before the cut, stream after it, some evaluations in both: the history of one batch job over all."""
    met = {"p": "0111011100110", "q": "1111111111111", "r": "0000000000001", "s": "1010101010101"}
    schema = "policy_id string, severity string, policy_source string, policy_rule string, threshold double, " + EVALUATION_SCHEMA.replace("policy_id string, ", "")
    rows = [(p, "LOW", None, None, 0.5, START + timedelta(hours=i), float(m), m == "1", 2) for p, ms in met.items() for i, m in enumerate(ms)]
    keys = ["policy_id", "evaluated_at", "status", "previous_status", "consecutive_breaches", "first_seen_at"]
    whole = alerts.alert_states(spark.createDataFrame(rows, schema))
    before = alerts.alert_states(spark.createDataFrame([r for r in rows if r[5] < START + timedelta(hours=cut)], schema))
    known_states(before).write.parquet(str(tmp_path / "known"))
    for part in range(3):
        some = [r for r in rows if r[5] >= START + timedelta(hours=cut - again) and (r[5] - START).seconds // 3600 % 13 // 5 == part]
        spark.createDataFrame(some, schema).select(*[c.split()[0] for c in EVALUATION_SCHEMA.split(", ")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVALUATION_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(state_stream(stream, spark.read.parquet(str(tmp_path / "known"))), str(tmp_path / "o"), str(tmp_path / "k"))
    after = spark.read.parquet(str(tmp_path / "o")).select(*keys).collect()
    assert sorted(map(str, before.select(*keys).collect() + after)) == sorted(map(str, whole.select(*keys).collect()))


def test_attempt_durations(spark, tmp_path):
    t = START
    spark.createDataFrame([(i, t + timedelta(minutes=i)) for i in range(5)], "attempt_id long, started_at timestamp").write.parquet(str(tmp_path / "s"))
    done = [(i, t + timedelta(minutes=i, milliseconds=1500 * i), "SENT") for i in range(4)]
    schema = "attempt_id long, completed_at timestamp, attempt_status string"
    spark.createDataFrame(done, schema).write.parquet(str(tmp_path / "c"))
    out = duration_stream(
        spark.readStream.schema("attempt_id long, started_at timestamp").parquet(str(tmp_path / "s")),
        spark.readStream.schema(schema).parquet(str(tmp_path / "c")))
    drain(out, str(tmp_path / "o"), str(tmp_path / "k"))
    got = {r["attempt_id"]: r["duration_ms"] for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {0: 0, 1: 1500, 2: 3000, 3: 4500}


def test_outcome_fold(spark, tmp_path):
    schema = "id long, success boolean, http_status int, max_attempts int, backoff_seconds int, finished_at timestamp"
    at = lambda m: START + timedelta(minutes=m)
    rows = [
        (1, False, 503, 3, 60, at(1)), (1, False, None, 3, 60, at(5)), (1, True, 204, 3, 60, at(9)), (1, True, 204, 3, 60, at(10)),
        (2, False, 400, 3, 60, at(1)),
        (3, False, 429, 2, 60, at(1)), (3, False, 500, 2, 60, at(2)),
    ]
    for half in (rows[::2], rows[1::2]):
        half = sorted(half, key=lambda r: r[-1])
        spark.createDataFrame(half, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    drain(outcome_stream(stream), str(tmp_path / "o"), str(tmp_path / "k"))
    got = sorted((r["id"], r["attempt"], r["status"], r["next_retry_at"]) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert [g[:3] for g in got] == [
        (1, 1, "RETRYING"), (1, 2, "RETRYING"), (1, 3, "SENT"), (2, 1, "DEAD"), (3, 1, "RETRYING"), (3, 2, "DEAD")]
    assert got[0][3] == at(2) and got[1][3] == at(7)


CHANNELS = [
    {"id": "channel_0", "target_url": "x"}, {"id": "channel_1", "target_url": "x", "backoff_seconds": 60},
    {"id": "channel_2", "target_url": "x", "backoff_seconds": 7200}, {"id": "channel_3"}, {"id": "gone", "target_url": "x", "enabled": False},
]


def test_delivery_stream_starts_from_the_outbox(spark, sf, tmp_path):
    """One outcome for every waiting item of the driver's log: the batch job's rows, from stored attempt counts."""
    outbox = tables.outbox(spark, sf)
    due, now = outbox.where(F.col("status").isin(*delivery.PENDING)), START
    batch = delivery.dispatch_outcomes(due, tables.delivery_results(spark, sf), CHANNELS, now)
    events = due.select("id", "channel_target", "event_type", "max_attempts").join(tables.delivery_results(spark, sf), "id", "left")
    events = events.withColumn("finished_at", F.lit(now))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    drain(delivery_stream(stream, outbox, CHANNELS), str(tmp_path / "o"), str(tmp_path / "k"))
    found = spark.read.parquet(str(tmp_path / "o"))
    assert {tuple(r) for r in found.select(*batch.columns).collect()} == {tuple(r) for r in batch.collect()} and found.count() == batch.count()
    assert {r.status for r in batch.select("status").distinct().collect()} == {"SENT", "DEAD", "RETRYING"}


def test_delivery_stream_over_several_attempts(spark, tmp_path):
    schema = (
        "id string, channel_target string, event_type string, max_attempts int, success boolean, http_status int, error_code string, "
        "error string, finished_at timestamp")
    at = lambda m: START + timedelta(minutes=m)
    row = lambda i, m, ok, code, channel="channel_1", most=3: (i, channel, "E", most, ok, code, None, None, at(m))
    rows = [
        row("a", 1, False, 503), row("a", 5, None, None), row("a", 9, True, 204), row("a", 10, True, 204),  # sent; a later one is ignored
        row("b", 1, False, 400),  # can't be retried
        row("c", 1, False, 429, most=2), row("c", 2, False, 500, most=2), row("c", 3, True, 200, most=2),  # used up
        row("d", 1, True, 200, "channel_3"), row("e", 1, True, 200, "nowhere"), row("f", 1, True, 200, "gone"),
        row("g", 1, False, 503, most=6), row("h", 1, True, 200), row("a2", 11, False, 500),  # g had 4 attempts, h was sent, a2 replays a
    ]
    outbox = spark.createDataFrame([("g", "RETRYING", 4), ("h", "SENT", 1), ("b", "PENDING", None)], "id string, status string, attempt_count int")
    for part in (rows[::3], rows[1::3], rows[2::3]):
        spark.createDataFrame(sorted(part, key=lambda r: r[-1]), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.createDataFrame(sorted(rows, key=lambda r: r[-1]), schema)
    whole.coalesce(1).write.parquet(str(tmp_path / "one"))
    expected = [
        ("a", 1, "RETRYING", at(2)), ("a", 2, "RETRYING", at(7)), ("a", 3, "SENT", None), ("a2", 1, "RETRYING", at(12)), ("b", 1, "DEAD", None),
        ("c", 1, "RETRYING", at(2)), ("c", 2, "DEAD", None), ("d", 1, "DEAD", None), ("e", 1, "DEAD", None), ("f", 1, "DEAD", None),
        ("g", 5, "RETRYING", at(17)),
    ]
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "one"))
    drain(delivery_stream(stream, outbox, CHANNELS), str(tmp_path / "o"), str(tmp_path / "k"))
    found = spark.read.parquet(str(tmp_path / "o"))
    assert sorted((r.id, r.attempt_count, r.status, r.next_retry_at) for r in found.collect()) == expected
    codes = {r.id: r.last_error_code for r in found.where("status = 'DEAD'").collect()}
    assert codes == {"b": "UNEXPECTED_ERROR", "c": "UNEXPECTED_ERROR", "d": "CHANNEL_TARGET_MISSING", "e": "CHANNEL_UNAVAILABLE", "f": "CHANNEL_UNAVAILABLE"}
    # The same outcomes in three micro-batches, one file each.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(delivery_stream(stream, outbox, CHANNELS), str(tmp_path / "o3"), str(tmp_path / "k3"))
    statuses = {}
    for r in spark.read.parquet(str(tmp_path / "o3")).collect():
        statuses.setdefault(r.id, []).append((r.attempt_count, r.status))
    assert {i: sorted(n for n, _ in s) for i, s in statuses.items() if i != "a"} == {"a2": [1], "b": [1], "c": [1, 2], "d": [1], "e": [1], "f": [1], "g": [5]}
    assert [sum(s in ("SENT", "DEAD") for _, s in own) for i, own in sorted(statuses.items()) if i in "abcdef"] == [1] * 6


def test_attempts_that_end_late_or_never(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    starts = [(1, at(0)), (2, at(1)), (3, at(2)), (4, at(3))]
    ends = [(1, at(1), "SENT"), (2, at(2), "DEAD"), (4, at(95), "SENT")]  # 3 never ends, 4 after its patience
    s_schema, c_schema = "attempt_id long, started_at timestamp", "attempt_id long, completed_at timestamp, attempt_status string"
    # Later events move the watermark on: without them an open attempt stays open.
    for part, (s, c) in enumerate([(starts, ends[:2]), ([(9, at(300))], ends[2:]), ([], [(9, at(301), "SENT")]), ([(10, at(600))], [(10, at(600), "SENT")])]):
        spark.createDataFrame(s, s_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        spark.createDataFrame(c, c_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
        out = attempt_stream(spark.readStream.schema(s_schema).parquet(str(tmp_path / "s")), spark.readStream.schema(c_schema).parquet(str(tmp_path / "c")))
        drain(out, str(tmp_path / "o"), str(tmp_path / "k"))
    got = spark.read.parquet(str(tmp_path / "o")).where("attempt_id < 5")
    closed = [e for e in ends if e[0] != 4]  # what had ended within its patience
    batch = delivery.attempt_durations(spark.createDataFrame(starts, s_schema), spark.createDataFrame(closed, c_schema))
    assert sorted(map(str, got.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))
    assert {r.attempt_id for r in got.where("attempt_status = 'STARTED'").collect()} == {3, 4}


@pytest.mark.parametrize("bad", [{"window_days": 0}, {"operator": "=>"}, {"metric_type": "nope"}, {"severity": "MAX"}])
def test_policy_checks(bad):
    good = dict(policy_id="p", severity="LOW", policy_source=None, window_days=1, metric_type="fail_rate", operator=">", threshold=0.1)
    with pytest.raises(ValueError):
        Policy(**{**good, **bad})
