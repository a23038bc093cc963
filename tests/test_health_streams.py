"""Absence and duration streams against the batch answer over the same log."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shelfscope.operators import counters
from shelfscope.streaming.health import heartbeat_stream, sustained_stream

START = datetime(2024, 1, 1)
SNAPSHOT = "source string, seen_at timestamp, high boolean"
CLOCK = "seen_at timestamp"


def at(seconds):
    return START + timedelta(seconds=seconds)


def drain(stream, path, checkpoint):
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def feed(spark, rows, schema, path, parts):
    """One file a micro-batch, rows in order of arrival."""
    for i in range(parts):
        part = rows[i * len(rows) // parts: (i + 1) * len(rows) // parts]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def snapshot_rows():
    """Scrapes of three sources that arrive up to 40 seconds late, with long and short stretches and fractions of a second."""
    dice = random.Random(7)
    rows = []
    for source in ("a", "b", "c"):
        high = False
        for i in range(40):
            high = high if dice.random() < 0.8 else not high
            rows.append((source, START + timedelta(seconds=30 * i + dice.randrange(20), microseconds=dice.randrange(10**6)), high))
    rows.append((None, at(100), True))
    return sorted(rows, key=lambda r: (r[1] + timedelta(seconds=dice.randrange(40))))


def test_sustained_conditions_equal_the_batch_rows(spark, tmp_path):
    rows = snapshot_rows()
    stream = feed(spark, rows, SNAPSHOT, str(tmp_path / "in"), 4)
    clock = feed(spark, [(at(s),) for s in (300, 700, 1300, 3600)], CLOCK, str(tmp_path / "clock"), 4)
    drain(sustained_stream(stream, ["source"], "seen_at", "high", 120, clock), str(tmp_path / "o"), str(tmp_path / "k"))
    found = spark.read.parquet(str(tmp_path / "o"))
    batch = counters.sustained(spark.createDataFrame(rows, SNAPSHOT), ["source"], "seen_at", "high", 120)
    got = found.where("NOT by_timer").select(*batch.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))
    assert {r.state for r in batch.collect()} == {"inactive", "pending", "firing"}

    # Timers: every stretch that lasts, seen or not, and has no earlier snapshot that says so.
    expected = set()
    for source in {r[0] for r in rows}:
        since, told = None, False
        for _, seen, high in [*sorted((r for r in rows if r[0] == source), key=lambda r: r[1]), (source, at(3600), None)]:
            if since and not told and since + timedelta(seconds=120) < seen:
                expected.add((source, since + timedelta(seconds=120), since))
                told = True
            since = (since or seen) if high else None
            told = bool(high) and (told or int(seen.timestamp()) - int(since.timestamp()) >= 120)
    timers = found.where("by_timer").select("source", "seen_at", "active_since").collect()
    assert {tuple(r) for r in timers} == expected and len(timers) == len(expected) > 2
    assert (None, at(220), at(100)) in expected


def test_heartbeats_equal_the_batch_answer_at_every_moment(spark, tmp_path):
    dice = random.Random(3)
    rows = [("a", at(s)) for s in range(0, 1200, 60)] + [("b", at(s)) for s in (0, 180, 361, 541, 900)]
    rows += [("c", at(10)), ("c", at(190) + timedelta(microseconds=999_999)), ("d", at(700)), ("d", at(700))]
    rows = sorted(rows, key=lambda r: r[1] + timedelta(seconds=dice.randrange(40)))
    schema = "source string, seen_at timestamp"
    stream = feed(spark, rows, schema, str(tmp_path / "in"), 3)
    clock = feed(spark, [(at(s),) for s in (200, 600, 3000)], CLOCK, str(tmp_path / "clock"), 3)
    drain(heartbeat_stream(stream, ["source"], "seen_at", 180, clock), str(tmp_path / "o"), str(tmp_path / "k"))
    events = spark.read.parquet(str(tmp_path / "o")).collect()
    log = spark.createDataFrame(rows, schema)
    for moment in (0, 100, 181, 191, 370, 371, 372, 542, 721, 722, 881, 900, 1081, 1400, 2900):
        batch = counters.heartbeat_age(log.where(F.col("seen_at") <= F.lit(at(moment))), ["source"], "seen_at", at(moment)).collect()
        newest = {}
        for e in sorted(events, key=lambda e: e.changed_at):
            if e.changed_at <= at(moment):
                newest[e.source] = e
        assert {s: e.event == "STALE" for s, e in newest.items()} == {r.source: r.is_stale for r in batch}, moment
        assert all(newest[r.source].last_tick == r.last_tick for r in batch if r.is_stale)
    assert {e.event for e in events} == {"ALIVE", "STALE"}
