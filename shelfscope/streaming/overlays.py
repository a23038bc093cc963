"""Silences and acknowledgements as streams over their command logs.

Commands wait in state until the watermark has passed them and are then taken in the order of (time, id), so commands that come out
of order within ``lateness`` give the batch job's answer. Starts and ends of silences are timers: they fire when nothing arrives.
State goes when a silence is over or an alert is cleared. A ``clock`` (rows with a time only) moves the watermark while
nobody gives a command.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfscope.operators.alerts import MATCHED

STATE_SCHEMA = "held string, waiting array<string>"


def _watermark(state: GroupState) -> int:
    return state.getCurrentWatermarkMs() * 1000


def _released(frames: Iterator[pd.DataFrame], state: GroupState) -> tuple[dict | None, list[dict], list[dict]]:
    """What is known of a key, its commands that the watermark has passed, in order, and those that have to wait."""
    held, waiting = tuple(state.get) if state.exists else (None, [])
    commands = list(waiting or []) + [line for frame in frames for line in frame["_command"].tolist()]
    rows = sorted((json.loads(c) for c in dict.fromkeys(commands)), key=lambda c: (c["at"], c["id"]))
    passed = _watermark(state)
    return json.loads(held) if held else None, [c for c in rows if c["at"] <= passed], [c for c in rows if c["at"] > passed]


def _keep(state: GroupState, held: dict | None, waiting: list[dict], deadline: int | None) -> None:
    if held is None and not waiting:
        if state.exists:
            state.remove()
        return
    state.update((json.dumps(held) if held else None, [json.dumps(c) for c in waiting]))
    wake = min([c["at"] for c in waiting] + ([deadline] if deadline is not None else []), default=None)
    if wake is not None:
        # The timer is in whole milliseconds and may not lie behind the watermark.
        state.setTimeoutTimestamp(max(-(-wake // 1000), state.getCurrentWatermarkMs() + 1))


def _silence_steps(names: list[str]) -> Callable:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[-1]:
            return
        held, ready, waiting = _released(frames, state)
        out = []

        def turn(end: int) -> None:
            """Start and end of the silence up to ``end``."""
            nonlocal held
            if held is None:
                return
            begins = max(held["starts"], held["at"])
            if not held["active"] and begins <= end and begins < held["ends"]:
                out.append((key[0], begins, "ACTIVE", *held["fields"]))
                held["active"] = True
            if held["ends"] <= end:
                out.append((key[0], max(held["ends"], held["at"]), "EXPIRED", *held["fields"]))
                held = None

        for command in ready:
            turn(command["at"])
            if command["kind"] == "create" and held is None:
                held = {**{k: command[k] for k in ("at", "starts", "ends", "fields")}, "active": False}
            elif command["kind"] == "expire" and held is not None:
                held["ends"] = command["at"]
            turn(command["at"])
        turn(_watermark(state))
        deadline = None if held is None else held["ends"] if held["active"] else min(max(held["starts"], held["at"]), held["ends"])
        _keep(state, held, waiting, deadline)
        yield pd.DataFrame(out, columns=names)

    return step


def _acknowledge_steps(names: list[str]) -> Callable:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[-1]:
            return
        held, ready, waiting = _released(frames, state)
        out = []
        for command in ready:
            if command["kind"] == "acknowledge":
                held = {"by": command["actor"]}
                out.append((key[0], command["at"], command["id"], "ACKNOWLEDGED", command["actor"]))
            elif held is not None:
                held = None
                out.append((key[0], command["at"], command["id"], "CLEARED", command["actor"]))
        _keep(state, held, waiting, None)
        yield pd.DataFrame(out, columns=names)

    return step


def _timed(commands: DataFrame, key: str, command: Column, clock: DataFrame | None, lateness: str) -> DataFrame:
    """Commands and clock in one input: key, ``_clock``, the time (watermarked) and the command as one JSON text."""
    own = commands.select(key, F.lit(False).alias("_clock"), F.col("made_at").alias("_time"), command.alias("_command"))
    if clock is not None:
        own = own.union(clock.select(F.lit(None).cast(commands.schema[key].dataType), F.lit(True), F.col("made_at"), F.lit("{}")))
    return own.withWatermark("_time", lateness)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"})


def silence_stream(commands: DataFrame, clock: DataFrame | None = None, lateness: str = "1 minute") -> DataFrame:
    """Changes of silences: silence_id, changed_at, event (ACTIVE or EXPIRED) and the fields that the silence matches.

    ``commands``: command_id, silence_id, command (create or expire), made_at, and for create starts_at, ends_at and the matched
    fields. A silence is ACTIVE from its start, or its creation if that is later, and EXPIRED at its end or at an expire command
    before it; one that has ended before it starts is only EXPIRED. The newest change up to a moment says what ``alerts.active_silences`` and
    ``alerts.expired_silences`` say at that moment (:func:`silences_at`). A second create of a live silence and an expire
    without a silence do nothing; a silence without start begins at once, one without end lasts until it is expired. Commands without id, time
    or silence are left out, those more than ``lateness`` late are dropped.
    """
    commands = commands.where("silence_id IS NOT NULL AND command_id IS NOT NULL AND made_at IS NOT NULL")
    command = _json(
        at=F.unix_micros("made_at"), id=F.col("command_id"), kind=F.col("command"),
        starts=F.coalesce(F.unix_micros("starts_at"), F.unix_micros("made_at")), ends=F.coalesce(F.unix_micros("ends_at"), F.lit(1 << 62)),
        fields=F.array(*[F.col(c).cast("string") for c in MATCHED]),
    )
    names = ["silence_id", "_at", "event", *MATCHED]
    schema = f"silence_id {commands.schema['silence_id'].dataType.simpleString()}, _at long, event string, " + ", ".join(f"{c} string" for c in MATCHED)
    steps = _timed(commands, "silence_id", command, clock, lateness).groupBy("silence_id", "_clock").applyInPandasWithState(
        _silence_steps(names), schema, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
    )
    return steps.select("silence_id", F.timestamp_micros("_at").alias("changed_at"), "event", *MATCHED)


def silences_at(changes: DataFrame, moment) -> DataFrame:
    """Silences in force at a moment, from the stored changes: silence_id, created_at (when it became active) and the matched fields,
    as ``alerts.with_silences`` takes them. A silence has two changes at most, so nothing is ranked."""
    known = changes.where(F.col("changed_at") <= F.lit(moment)).groupBy("silence_id").agg(
        F.bool_or(F.col("event") == "EXPIRED").alias("over"), F.min("changed_at").alias("created_at"), *[F.max(c).alias(c) for c in MATCHED]
    )
    return known.where("NOT over").drop("over")


def acknowledgement_stream(commands: DataFrame, clock: DataFrame | None = None, lateness: str = "1 minute") -> DataFrame:
    """Changes of acknowledgements: alert_id, changed_at, command_id, event (ACKNOWLEDGED or CLEARED) and actor.

    ``commands`` as ``alerts.active_acknowledgements`` takes them: command_id, alert_id, command, made_at, actor. Of the changes up to
    a moment the newest by (changed_at, command_id) says what the batch form says at that moment. Whatever isn't an acknowledge clears; a
    clear without an acknowledgement changes nothing. Commands without id, time or alert are left out.
    """
    commands = commands.where("alert_id IS NOT NULL AND command_id IS NOT NULL AND made_at IS NOT NULL")
    command = _json(at=F.unix_micros("made_at"), id=F.col("command_id"), kind=F.col("command"), actor=F.col("actor"))
    names = ["alert_id", "_at", "command_id", "event", "actor"]
    kinds = {c: commands.schema[c].dataType.simpleString() for c in ("alert_id", "command_id")}
    schema = f"alert_id {kinds['alert_id']}, _at long, command_id {kinds['command_id']}, event string, actor string"
    steps = _timed(commands, "alert_id", command, clock, lateness).groupBy("alert_id", "_clock").applyInPandasWithState(
        _acknowledge_steps(names), schema, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
    )
    return steps.select("alert_id", F.timestamp_micros("_at").alias("changed_at"), "command_id", "event", "actor")
