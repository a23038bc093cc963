"""Repeated byte strings by prefix-free parsing.

A rolling hash picks trigger places: of any ``SPREAD`` places in a row the one with the smallest hash. The trigger that
belongs to a string of ``length`` bytes depends on its first bytes only, so equal strings have equal triggers, and the
corpus becomes a parse over triggers, some eighty bytes a step, in place of a byte a step. Strings are compared by the
equality classes of their text, which is all that a corpus order is needed for here; a class is counted by partial
sums, so a string that a third of all documents share is no hot task, while a sorted run of its suffixes would be.

The strings of a trigger are judged together. Their common core is hashed first: if no other place has that core, none
of them is repeated. Then their hull: if another place has it, all of them are. What is left - triggers at the edges of
repeated passages - is cut into cells of sixteen strings, judged likewise, and what is still open string by string; one
range of each hull that is known to be repeated goes along, as edges may be repeated there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm import word_hash
from shelfscope.llm.scratch import written

SPREAD = 160
TRIGGER_BYTES = 8
CELL = 16
SECOND = np.uint64(0xD6E8FEB86659FD93)


def _triggers(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first start, last start) of each trigger and of the strings that belong to it, in order of place."""
    n = len(data) - TRIGGER_BYTES + 1
    if n < SPREAD:
        return (np.zeros(0, np.int64),) * 3
    grams = np.lib.stride_tricks.sliding_window_view(data, TRIGGER_BYTES)
    grams = np.ascontiguousarray(grams).view("<u8").ravel()
    grams = (grams ^ (grams >> np.uint64(29))) * word_hash.BASE
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)  # of equal hashes the first place
    span = 1
    while 2 * span <= SPREAD:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < SPREAD:
        least = np.minimum(least[: len(least) - (SPREAD - span)], least[SPREAD - span :])
    valid = np.zeros(len(least), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= length:
            valid[a : b - length + 1] = True
    starts = np.flatnonzero(valid)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return place[first], starts[first], starts[last]


def _parsed(docs: DataFrame, length: int) -> DataFrame:
    """(core, text_key, place): a row for each trigger; ``place`` packs its byte, and how far its strings start before."""
    forward = length - SPREAD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for first, stop, data, offsets in word_hash.portions(batch.column(1)):
                at, lo, hi = _triggers(data, offsets, length)
                owner = np.searchsorted(offsets, at, "right") - 1
                core = word_hash.mix(word_hash.range_hash(word_hash.prefix_hash(data), at, at + forward))
                packed = (at - offsets[owner]) << 16 | (at - lo) << 8 | (at - hi)
                columns = [pa.array(core.view(np.int64)), pa.array(keys[first:stop][owner]), pa.array(packed)]
                yield pa.RecordBatch.from_arrays(columns, ["core", "text_key", "place"])

    return written(docs.select("text_key", "text").mapInArrow(run, "core long, text_key long, place long"), "parse")


def _cells(place: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Cells of ``size`` distances from the trigger: (place, cell, first start, last start) of those with a start."""
    found = []
    for cell in range(-(-SPREAD // size)):
        a, b = np.maximum(lo, place - (cell + 1) * size + 1), np.minimum(hi, place - cell * size)
        some = a <= b
        found.append((place[some], np.full(int(some.sum()), cell), a[some], b[some]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _hashed(texts: DataFrame, open_: DataFrame, length: int, size: int) -> DataFrame:
    """(h1, h2, core, text_key, at, lo, hi): hull and core of the cells of the open ranges. A core is a filter only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "core", "text_key", "at", "lo", "hi"]
        for batch in batches:
            for key, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                first, second = word_hash.prefix_hash(data), word_hash.prefix_hash(data ^ np.uint8(0x5A))
                parts = ranges.values
                at, lo, hi = (parts.field(i).to_numpy().astype(np.int64) for i in range(3))
                at, cell, lo, hi = _cells(at, lo, hi, size)
                last = at - cell * size  # the last start that the cell could have
                core = word_hash.mix(word_hash.range_hash(first, last, last - size + 1 + length))
                n = (hi - lo).astype(np.uint64)
                one = word_hash.mix(word_hash.range_hash(first, lo, hi + length) + n)
                two = word_hash.mix(word_hash.range_hash(second, lo, hi + length) * SECOND + n)
                columns = [pa.array(x.view(np.int64)) for x in (one, two, core)] + [pa.array(np.full(len(at), key, np.int64))]
                columns += [pa.array(x.astype(np.int32)) for x in (at, lo, hi)]
                yield pa.RecordBatch.from_arrays(columns, names)

    ranges = open_.groupBy("text_key").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("ranges"))  # of one text
    rows = texts.join(ranges, "text_key").select("text_key", "text", "ranges")
    schema = "h1 long, h2 long, core long, text_key long, at int, lo int, hi int"
    return written(rows.mapInArrow(run, schema), f"cells-{size}")


def _judged(cells: DataFrame) -> DataFrame:
    """``cells`` plus ``again``: whether the hull also stands at another place, and ``first``: of equal hulls one has it."""
    place = F.xxhash64("text_key", "lo", "hi")
    # Written before the join, so that adaptive execution can split the rows of a hull that a third of all cells share.
    repeated = cells.groupBy("h1", "h2").agg(F.min(place).alias("p"), F.max(place).alias("q")).filter("p <> q").drop("q")
    judged = cells.join(written(repeated, "repeated-hulls"), ["h1", "h2"], "left")
    return written(judged.select(*cells.columns[2:], F.col("p").isNotNull().alias("again"), F.coalesce(place == F.col("p"), F.lit(True)).alias("first")), "judged")


def _still_open(judged: DataFrame) -> DataFrame:
    """Ranges to look at more closely: those that aren't repeated as a whole but have a core that stands elsewhere too,
    and with each such core one range of every repeated hull, as what they may be compared with."""
    place = F.xxhash64("text_key", "lo", "hi")
    cores = judged.groupBy("core").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.min(F.col("again").cast("int")).alias("all_again"))
    live = written(cores.filter("p <> q AND all_again = 0").select("core"), "live-cores")  # before the join, as above
    return judged.filter("first OR NOT again").join(live, "core", "left_semi").select("text_key", "at", "lo", "hi").distinct()


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, spans (array of (start, end), bytes to remove, maximal runs) and kept_sha256.

    A byte is in a span if a string of ``length`` bytes that covers it also starts anywhere else, in this text or in
    another; strings never run over the end of a text. ``length`` must exceed ``SPREAD`` plus ``TRIGGER_BYTES``.

    Texts move once, and of those only the ones with a repeated core are kept for the later rounds. Copies of a text
    are found by its hash and are judged as one.

    Defined cases: a null text has no bytes; texts shorter than ``length`` lose nothing; equal rows repeat each other;
    null and repeated ids give a row each; an empty table gives no rows; further columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    rows = docs.select("doc_id", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    rows = written(rows, "text-rows")
    copies = rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))

    parse = _parsed(docs, length)
    spot = F.xxhash64("text_key", "place")
    shared = parse.groupBy("core").agg(F.min(spot).alias("p"), F.max(spot).alias("q")).filter("p <> q").select("core")
    shared = written(shared, "shared-cores")  # the rows of a core that many texts share can then be split
    at = F.shiftright("place", 16).cast("int")
    open_ = parse.join(shared, "core", "left_semi").select("text_key", "place").distinct()
    open_ = open_.select(
        "text_key", at.alias("at"), (at - F.shiftright("place", 8).bitwiseAND(255)).cast("int").alias("lo"),
        (at - F.col("place").bitwiseAND(255)).cast("int").alias("hi"),
    )
    open_ = written(open_, "open")
    wanted = open_.select("text_key").distinct().join(copies, "text_key").select(F.col("text_key").alias("key"), "first_id")
    found = docs.join(wanted, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    texts = written(found.select("text_key", "text"), "texts")

    spans = None
    for size in (SPREAD, CELL, 1):
        judged = _judged(_hashed(texts, open_, length, size))
        own = judged.filter("again").select("text_key", F.col("lo").alias("start"), (F.col("hi") + length).alias("end")).distinct()
        spans = own if spans is None else spans.union(own)
        open_ = _still_open(judged)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged, digests = [], []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                data, own, kept, at = text.as_buffer().to_pybytes(), [], hashlib.sha256(), 0
                for start, end in sorted((r["start"], r["end"]) for r in ranges.as_py()):
                    if own and start <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], end)
                    else:
                        own.append({"start": start, "end": end})
                for span in own:
                    kept.update(data[at : span["start"]])
                    at = span["end"]
                kept.update(data[at:])
                merged.append(own)
                digests.append(kept.hexdigest())
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, span), pa.array(digests, pa.string())], ["text_key", "spans", "kept"])

    ranges = spans.groupBy("text_key").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))  # of one text
    cut_texts = texts.join(ranges, "text_key").select("text_key", "text", "ranges")
    kept = cut_texts.mapInArrow(cut, "text_key long, spans array<struct<start:int,end:int>>, kept string").dropDuplicates(["text_key"])
    result = rows.join(copies.select("text_key", "copies"), "text_key", "left").join(kept, "text_key", "left")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return result.select(
        "doc_id",
        "n_bytes",
        F.when(copied, all_of_it).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    )
