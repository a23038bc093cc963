"""Silence and acknowledgement streams against the batch answers at every tick."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shelfscope.operators import alerts
from shelfscope.streaming.overlays import acknowledgement_stream, silence_stream, silences_at
from test_health_streams import drain, feed

START = datetime(2024, 1, 1)
SILENCE = (
    "command_id long, silence_id long, command string, made_at timestamp, starts_at timestamp, ends_at timestamp, "
    "policy_id string, source_name string, severity string, rule_id string"
)
ACK = "command_id long, alert_id long, command string, made_at timestamp, actor string"
CLOCK = "made_at timestamp"
TICKS = [START + timedelta(seconds=s) for s in range(0, 4200, 300)]


def arrivals(rows, dice, index):
    """In order of arrival, up to 40 seconds late."""
    return sorted(rows, key=lambda r: r[index] + timedelta(seconds=dice.randrange(40)))


def silence_commands(dice):
    rows, number = [], 0
    for silence in range(60):
        made = START + timedelta(seconds=dice.randrange(2400), microseconds=dice.randrange(10**6))
        begins = made + timedelta(seconds=dice.choice([-50, 0, 90, 400]))
        ends = begins + timedelta(seconds=dice.choice([0, 30, 300, 900, 1500]))
        fields = [f"p{silence % 4}", dice.choice([None, "train"]), dice.choice([None, "HIGH", "LOW"]), dice.choice([None, "r1"])]
        rows.append((number, silence, "create", made, begins, ends, *fields))
        if dice.random() < 0.4:
            at = made + timedelta(seconds=dice.randrange(0, 800))
            rows.append((number + 1, silence, "expire", at, None, None, None, None, None, None))
        if dice.random() < 0.2:
            rows.append(rows[-1])
        number += 2
    return arrivals(rows, dice, 3)


def as_of(rows, tick):
    """The table of silences that the commands up to a tick have left, as a service keeps it."""
    table = {}
    for number, silence, command, made, begins, ends, *fields in sorted(set(rows), key=lambda r: (r[3], r[0])):
        if made > tick:
            continue
        if command == "create" and silence not in table:
            table[silence] = [silence, made, begins, ends, None, *fields]
        elif command == "expire" and silence in table and table[silence][3] > made:
            table[silence][4] = made
    return [tuple(r) for r in table.values()]


def test_silences_equal_the_batch_overlay_at_every_tick(spark, tmp_path):
    dice = random.Random(11)
    rows = silence_commands(dice)
    stream = feed(spark, rows, SILENCE, str(tmp_path / "in"), 5)
    clock = feed(spark, [(START + timedelta(seconds=s),) for s in (0, 10, 20, 30, 9000)], CLOCK, str(tmp_path / "clock"), 5)
    drain(silence_stream(stream, clock), str(tmp_path / "o"), str(tmp_path / "k"))
    changes = spark.read.parquet(str(tmp_path / "o")).cache()
    items = spark.createDataFrame(
        [(i, f"p{i % 6}", "train" if i % 2 else "store", ("HIGH", "LOW", "MEDIUM")[i % 3], "r1" if i % 5 else None) for i in range(30)],
        "alert_id long, policy_id string, source_name string, severity string, rule_id string",
    )
    table = "silence_id long, created_at timestamp, starts_at timestamp, ends_at timestamp, expired_at timestamp, policy_id string, source_name string, severity string, rule_id string"
    seen = 0
    for tick in TICKS:
        batch = spark.createDataFrame(as_of(rows, tick), table)
        active = alerts.active_silences(batch, tick)
        found = silences_at(changes, tick)
        assert {r[0] for r in found.collect()} == {r.silence_id for r in active.collect()}
        over = {r[0] for r in changes.where((F.col("changed_at") <= F.lit(tick)) & (F.col("event") == "EXPIRED")).collect()}
        assert over == {r.silence_id for r in alerts.expired_silences(batch, tick).where("expired_at IS NOT NULL").collect()}
        seen += len(over)
    assert seen
    mid = TICKS[5]
    flags = lambda s: {(r.alert_id, r.is_silenced) for r in alerts.with_silences(items, s).collect()}
    expected = flags(alerts.active_silences(spark.createDataFrame(as_of(rows, mid), table), mid))
    assert flags(silences_at(changes, mid)) == expected and {s for _, s in expected} == {True, False}


def test_acknowledgements_equal_the_batch_overlay_at_every_tick(spark, tmp_path):
    dice = random.Random(5)
    rows = [
        (i, dice.randrange(12), dice.choice(["acknowledge", "acknowledge", "clear"]), START + timedelta(seconds=dice.randrange(3000)), f"u{i % 3}")
        for i in range(200)
    ]
    rows = arrivals(rows + rows[:5] + [(999, None, "clear", START, "u")], dice, 3)
    stream = feed(spark, rows, ACK, str(tmp_path / "in"), 5)
    clock = feed(spark, [(START + timedelta(seconds=s),) for s in (0, 10, 20, 30, 9000)], CLOCK, str(tmp_path / "clock"), 5)
    drain(acknowledgement_stream(stream, clock), str(tmp_path / "o"), str(tmp_path / "k"))
    changes = spark.read.parquet(str(tmp_path / "o")).collect()
    commands = spark.createDataFrame([r for r in rows if r[1] is not None], ACK)
    for tick in TICKS[::3]:
        batch = alerts.active_acknowledgements(commands.where(F.col("made_at") <= F.lit(tick)))
        newest = {}
        for c in sorted((c for c in changes if c.changed_at <= tick), key=lambda c: (c.changed_at, c.command_id)):
            newest[c.alert_id] = c
        got = {(c.alert_id, c.actor, c.changed_at) for c in newest.values() if c.event == "ACKNOWLEDGED"}
        assert got == {(r.alert_id, r.acknowledged_by, r.acknowledged_at) for r in batch.collect()}


def test_no_commands(spark, tmp_path):
    for name, build, schema in (("s", silence_stream, SILENCE), ("a", acknowledgement_stream, ACK)):
        stream = feed(spark, [], schema, str(tmp_path / f"{name}in"), 1)
        drain(build(stream), str(tmp_path / f"{name}o"), str(tmp_path / f"{name}k"))
        assert spark.read.schema("silence_id long").parquet(str(tmp_path / f"{name}o")).count() == 0
