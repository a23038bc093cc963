"""Absence and duration conditions as streams: timers fire when nothing arrives.

Rows wait in state until the watermark has passed them and are then taken in time order, so rows that come out of order
within ``lateness`` give the batch job's answer. The watermark moves with the latest row of any key; a ``clock`` (rows with a time
only) moves it while no key reports at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICROS = 1_000_000
STATE_SCHEMA = "since long, last long, told boolean, waiting array<long>, holding array<boolean>"


def _released(frames: Iterator[pd.DataFrame], state: GroupState, held: tuple) -> tuple[list[tuple[int, bool]], list[tuple[int, bool]]]:
    """Rows of one key that the watermark has passed, in time order, and those that have to wait.

    A key has one row a scrape, so what waits is bounded by the lateness.
    """
    rows = list(zip(held[3] or [], held[4] or []))
    for frame in frames:
        rows += list(zip(frame["_at"].tolist(), frame["_holds"].tolist()))
    passed = state.getCurrentWatermarkMs() * 1000
    return sorted(r for r in rows if r[0] <= passed), sorted(r for r in rows if r[0] > passed)


def _wait(state: GroupState, since: int | None, last: int | None, told: bool, waiting: list, deadline: int | None) -> None:
    """Keep what is known of a key and wake up at its next waiting row or deadline."""
    state.update((since, last, told, [at for at, _ in waiting], [holds for _, holds in waiting]))
    wake = min([at for at, _ in waiting] + ([deadline] if deadline is not None else []), default=None)
    if wake is not None:
        # The timer is in whole milliseconds and may not lie behind the watermark.
        state.setTimeoutTimestamp(max(-(-wake // 1000), state.getCurrentWatermarkMs() + 1))


def _known(state: GroupState) -> tuple:
    return tuple(state.get) if state.exists else (None, None, False, [], [])


def _duration_steps(seconds: int, names: list[str]) -> Callable:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[-1]:
            return
        held = _known(state)
        since, last, told = held[:3]
        ready, waiting = _released(frames, state, held)
        out = []

        def fire_before(end: int) -> bool:
            """The row of a deadline that lies between two snapshots."""
            due = since is not None and not told and since + seconds * MICROS < end
            if due:
                out.append((*key[:-1], since + seconds * MICROS, True, since, "firing", True))
            return told or due

        for at, holds in ready:
            told = fire_before(at)
            since = (at if since is None else since) if holds else None
            # Whole seconds, as the batch form counts them.
            long_enough = since is not None and at // MICROS - since // MICROS >= seconds
            told = holds and (told or long_enough)
            out.append((*key[:-1], at, holds, since, "firing" if long_enough else "pending" if holds else "inactive", False))
            last = at
        told = fire_before(state.getCurrentWatermarkMs() * 1000 + 1)
        deadline = since + seconds * MICROS if since is not None and not told else None
        _wait(state, since, last, told, waiting, deadline)
        yield pd.DataFrame(out, columns=names).astype({"_since": "Int64", "_at": "int64"})

    return step


def _heartbeat_steps(stale_seconds: int, names: list[str]) -> Callable:
    # The age counts whole seconds and has to exceed the limit.
    limit = (stale_seconds + 1) * MICROS

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[-1]:
            return
        held = _known(state)
        _, last, stale = held[:3]
        ready, waiting = _released(frames, state, held)
        out = []
        for at, _ in ready:
            if last is not None and not stale and at - last >= limit:
                out.append((*key[:-1], last + limit, "STALE", last))
                stale = True
            if last is None or stale:
                out.append((*key[:-1], at, "ALIVE", at))
            last, stale = at, False
        if last is not None and not stale and last + limit <= state.getCurrentWatermarkMs() * 1000:
            out.append((*key[:-1], last + limit, "STALE", last))
            stale = True
        _wait(state, None, last, stale, waiting, None if stale or last is None else last + limit)
        yield pd.DataFrame(out, columns=names)

    return step


def _timed(rows: DataFrame, keys: list[str], ts: str, holds, clock: DataFrame | None, lateness: str) -> DataFrame:
    """Rows and clock in one input: keys, ``_clock``, the time (watermarked), ``_at`` in microseconds and ``_holds``."""
    own = rows.select(*keys, F.lit(False).alias("_clock"), F.col(ts).alias("_time"), holds.alias("_holds"))
    if clock is not None:
        nothing = [F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys]
        own = own.union(clock.select(*nothing, F.lit(True), F.col(ts), F.lit(False)))
    return own.withWatermark("_time", lateness).withColumn("_at", F.unix_micros("_time"))


def _fields(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)


def sustained_stream(
    snapshots: DataFrame, keys: list[str], ts: str, condition: str, seconds: int, clock: DataFrame | None = None, lateness: str = "1 minute"
) -> DataFrame:
    """keys, time, condition, active_since and state of every snapshot as ``counters.sustained`` gives them, and by_timer.

    A condition holds until a snapshot says otherwise. Where it has held for ``seconds`` between two snapshots, a row of its
    own says so at that moment (``by_timer``), also if no further snapshot comes. A null condition doesn't hold. Snapshots more
    than ``lateness`` behind the latest row are dropped.
    """
    rows = _timed(snapshots, keys, ts, F.coalesce(F.col(condition), F.lit(False)), clock, lateness)
    schema = f"{_fields(snapshots, keys)}, _at long, _holds boolean, _since long, state string, by_timer boolean"
    names = [*keys, "_at", "_holds", "_since", "state", "by_timer"]
    steps = rows.groupBy(*keys, "_clock").applyInPandasWithState(
        _duration_steps(seconds, names), schema, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
    )
    return steps.select(
        *keys, F.timestamp_micros("_at").alias(ts), F.col("_holds").alias(condition), F.timestamp_micros("_since").alias("active_since"), "state", "by_timer"
    )


def heartbeat_stream(
    ticks: DataFrame, keys: list[str], ts: str, stale_seconds: int = 180, clock: DataFrame | None = None, lateness: str = "1 minute"
) -> DataFrame:
    """Changes of liveness: keys, changed_at, event (ALIVE or STALE) and last_tick.

    A key is ALIVE from its first tick, STALE from the moment its age in whole seconds exceeds ``stale_seconds`` and ALIVE
    again from the next tick. The newest change up to a moment says what ``counters.heartbeat_age`` says at that moment; keys
    that never ticked have no row in either.
    """
    rows = _timed(ticks, keys, ts, F.lit(True), clock, lateness)
    names = [*keys, "_at", "event", "_last"]
    schema = f"{_fields(ticks, keys)}, _at long, event string, _last long"
    steps = rows.groupBy(*keys, "_clock").applyInPandasWithState(
        _heartbeat_steps(stale_seconds, names), schema, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
    )
    return steps.select(*keys, F.timestamp_micros("_at").alias("changed_at"), "event", F.timestamp_micros("_last").alias("last_tick"))
