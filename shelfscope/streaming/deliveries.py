"""Delivery streams: pairing of attempt starts and completions, and folding of outcomes per outbox item."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfscope.functions.numeric import MAX_BACKOFF_SECONDS, RETRYABLE_STATUSES, elapsed_ms
from shelfscope.operators import delivery

STATE_SCHEMA = "status string, attempts int"
OUTPUT_SCHEMA = "id long, attempt int, status string, next_retry_at timestamp, finished_at timestamp"


def duration_stream(started: DataFrame, completed: DataFrame, patience: str = "1 hour") -> DataFrame:
    """Completed attempts with their duration: an inner stream join within a time range, so state is dropped
    once the watermark has passed it."""
    s = started.select("attempt_id", "started_at").withWatermark("started_at", patience).alias("s")
    c = completed.select(
        F.col("attempt_id").alias("done_id"), "completed_at", "attempt_status"
    ).withWatermark("completed_at", patience).alias("c")
    same = (F.col("attempt_id") == F.col("done_id")) & (F.col("completed_at") >= F.col("started_at")) & (
        F.col("completed_at") <= F.col("started_at") + F.expr(f"INTERVAL {patience}")
    )
    return s.join(c, same).select(
        "attempt_id", "started_at", "completed_at", "attempt_status",
        elapsed_ms(F.col("started_at"), F.col("completed_at")).alias("duration_ms"),
    )


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Outcomes of one item in time order; a sent or dead item takes no further outcome."""
    rows = pd.concat(list(frames)).sort_values("finished_at")
    status, attempts = tuple(state.get) if state.exists else ("PENDING", 0)
    out = []
    for row in rows.itertuples(index=False):
        if status in ("SENT", "DEAD"):
            break
        attempts += 1
        code = None if pd.isna(row.http_status) else int(row.http_status)
        again = code is None or code in RETRYABLE_STATUSES or code >= 500
        retry_at = pd.NaT
        if row.success:
            status = "SENT"
        elif again and attempts < row.max_attempts:
            status = "RETRYING"
            delay = min(max(1, row.backoff_seconds) * 2 ** (attempts - 1), MAX_BACKOFF_SECONDS)
            retry_at = row.finished_at + pd.Timedelta(seconds=delay)
        else:
            status = "DEAD"
        out.append((key[0], attempts, status, retry_at, row.finished_at))
    state.update((status, attempts))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT_SCHEMA.split(", ")])
    yield frame.astype({"next_retry_at": "datetime64[ns]", "finished_at": "datetime64[ns]"})


def outcome_stream(outcomes: DataFrame) -> DataFrame:
    """Item states from a stream of outcomes: id, success, http_status, max_attempts, backoff_seconds, finished_at."""
    return outcomes.groupBy("id").applyInPandasWithState(
        _fold, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


def attempt_stream(started: DataFrame, completed: DataFrame, patience: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """All attempts, as ``delivery.attempt_durations`` gives them over a log that is closed.

    A completion is paired with its start if it comes within ``patience``. A start without one is kept until the watermark, the
    latest event of the slower side less ``lateness``, has passed its patience, and then comes out as STARTED: a left outer stream
    join, which both sides' watermarks and the time range let drop its state.
    """
    s = started.select("attempt_id", "started_at").withWatermark("started_at", lateness)
    c = completed.select(F.col("attempt_id").alias("done_id"), "completed_at", "attempt_status").withWatermark("completed_at", lateness)
    within = (F.col("completed_at") >= F.col("started_at")) & (F.col("completed_at") <= F.col("started_at") + F.expr(f"INTERVAL {patience}"))
    return s.join(c, (F.col("attempt_id") == F.col("done_id")) & within, "left_outer").select(
        "attempt_id",
        "started_at",
        "completed_at",
        F.coalesce("attempt_status", F.lit("STARTED")).alias("attempt_status"),
        elapsed_ms(F.col("started_at"), F.col("completed_at")).alias("duration_ms"),
    )


def _attempt_counter(keep_ended_ms: int):
    """Numbers the outcomes of one item and lets none through after the item has ended.

    Without state an item starts from ``known_attempts`` and ``known_status`` of its rows. The state is the attempt count and
    whether the item has ended; that of an ended item expires, until then outcomes that are delivered again are ignored.
    """

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # One item has as many outcomes in a micro-batch as attempts were made since the last one.
        batch = pd.concat(list(frames)).sort_values("finished_at", kind="stable")
        first = batch.iloc[0]
        before, ended = tuple(state.get) if state.exists else (int(first["known_attempts"]), first["known_status"] in ("SENT", "DEAD"))
        if not ended:
            batch["attempt"] = range(before + 1, before + 1 + len(batch))
            last = (batch["ends"] | (batch["attempt"] >= batch["max_attempts"])).to_numpy()
            ended = bool(last.any())
            batch = batch.iloc[: last.argmax() + 1] if ended else batch
            before += len(batch)
            yield batch
        state.update((before, ended))
        if ended:
            state.setTimeoutTimestamp(int(first["finished_at"].timestamp() * 1000) + keep_ended_ms)

    return count


def delivery_stream(outcomes: DataFrame, outbox: DataFrame, channels: list[dict], keep_ended: str = "7 days", lateness: str = "1 day") -> DataFrame:
    """States of outbox items from a stream of outcomes, row for row as ``delivery.dispatch_outcomes`` gives them.

    ``outcomes``: id, channel_target, event_type, max_attempts, success, http_status, error_code, error, finished_at; an
    outcome without ``success`` is an unexpected, retryable error. ``outbox`` (id, status, attempt_count), a fixed version of
    the table, is where items without state start from; items that it lacks, such as replayed ones with their new ids, start at
    no attempts. Status, codes and retry times are the batch job's columns; only the attempts are counted by state. Outcomes
    more than ``lateness`` behind the latest one are dropped; an ended item is forgotten ``keep_ended`` after its outcome.
    """
    rows = delivery.with_channel(outcomes.withWatermark("finished_at", lateness), channels).withColumn("ends", delivery.ends_item()).drop("channel")
    known = outbox.select("id", F.col("status").alias("known_status"), F.col("attempt_count").cast("int").alias("known_attempts"))
    rows = rows.join(known, "id", "left").fillna({"known_attempts": 0})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    keep_ms = int(pd.Timedelta(keep_ended).total_seconds() * 1000)
    counted = rows.groupBy("id").applyInPandasWithState(
        _attempt_counter(keep_ms), f"{fields}, attempt int", "attempts int, ended boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
    return delivery.outcome_rows(delivery.with_channel(counted, channels), F.col("finished_at"))
