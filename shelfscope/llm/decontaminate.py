"""Benchmark decontamination over a positional inverted index of the training texts.

The index is cut into segments, each over the texts of one Arrow batch: a row holds the places of one term in one
segment's running word count, where texts are a gap apart, so that a phrase never runs from one text into the next.
A test phrase is looked up per segment: its rarest term gives the first list of starts, which is intersected with the
lists of the other terms, rarer ones first, each moved by the term's offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm import word_hash
from shelfscope.llm.scratch import settled, written

# Words are runs of 0-9, a-z and characters beyond ASCII.
WORD = word_hash.letters("".join(chr(c) for c in range(128) if not (chr(c).isdigit() or "a" <= chr(c) <= "z")))
DIRECTORY = 0  # the term under which a segment keeps its texts: word counts, not places
GAP = 64  # least distance of texts in words; phrases and spans must be shorter
MOST_TERMS_SENT = 200_000  # test terms sent to every executor (1.6 MB); with more of them all terms are indexed


def _packed(numbers: np.ndarray) -> bytes:
    return zlib.compress(np.diff(numbers, prepend=0).astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4"), dtype=np.int64)


def terms_of(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, terms): each text's words in order as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in word_hash.portions(batch.column(1)):
                hashes, at = word_hash.words(data, offsets, WORD)
                terms = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
                counts = pa.array(np.diff(at).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), counts, terms], ["id", "n_words", "terms"])

    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, terms array<long>")


def windows_of(items: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, terms): every ``width`` words in a row of an item, all of it if it has fewer. ``item`` is text."""
    terms = terms_of(items, id_col, text_col).filter("n_words > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("terms") - width + 1, F.lit(1)))
    return terms.select(F.col("id").cast("string").alias("item"), "terms", F.explode(starts).alias("at")).select(
        "item", F.slice("terms", F.col("at"), width).alias("terms")
    ).distinct()


def build_index(docs: DataFrame, only: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(segment, term, n, places): the stored postings. ``only`` (term) limits it to terms that will be asked for.

    The places of term ``DIRECTORY`` are the texts' word counts, ``ids`` their ids in the same order.
    """
    wanted = None
    if only is not None and only.limit(MOST_TERMS_SENT + 1).count() <= MOST_TERMS_SENT:
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in only.collect()], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, stop, data, offsets in word_hash.portions(batch.column(1)):
                hashes, at = word_hash.words(data, offsets, WORD)
                hashes, counts = hashes.view(np.int64), np.diff(at)
                places = np.arange(len(hashes)) + np.repeat(np.arange(stop - first) * GAP, counts)
                if wanted is not None:
                    terms = wanted.value
                    found = np.searchsorted(terms, hashes)
                    known = terms[np.minimum(found, len(terms) - 1)] == hashes if len(terms) else np.zeros(len(hashes), bool)
                    hashes, places = hashes[known], places[known]
                order = np.argsort(hashes, kind="stable")
                hashes, places = hashes[order], places[order]
                cuts = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] - 1)) if len(hashes) else np.zeros(0, np.int64)
                lists = np.split(places, cuts[1:]) if len(cuts) else []
                ids = batch.column(0).slice(first, stop - first)
                columns = [
                    pa.array([segment] * (len(cuts) + 1), pa.int64()),
                    pa.array([DIRECTORY, *hashes[cuts].tolist()], pa.int64()),
                    pa.array([stop - first, *map(len, lists)], pa.int64()),
                    pa.array([zlib.compress(counts.astype("<i4").tobytes(), 1), *map(_packed, lists)], pa.binary()),
                    pa.array([ids.to_pylist(), *[None] * len(cuts)], pa.list_(ids.type)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "term", "n", "places", "ids"])
                segment += 1

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"segment long, term long, n long, places binary, ids array<{id_type}>"), "postings")


def _matches(terms: np.ndarray, lists: dict[int, np.ndarray], sizes: dict[int, int], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the terms in order with at most ``slop`` other words among them; the nearest end of each start."""
    if slop:  # a start is a place of the first term; taking the next place of each further term gives the least end
        starts = lists[terms[0]]
        last = starts
        for term in terms[1:]:
            places = lists[term]
            at = np.searchsorted(places, last, "right")
            ok = at < len(places)
            starts, last = starts[ok], places[at[ok]]
            near = last - starts <= len(terms) - 1 + slop
            starts, last = starts[near], last[near]
        return starts, last + 1
    starts = None
    for j in sorted(range(len(terms)), key=lambda j: sizes[terms[j]]):
        places = lists[terms[j]]
        if starts is None:
            starts = places - j
            continue
        at = np.searchsorted(places, starts + j)
        starts = starts[(at < len(places)) & (places[np.minimum(at, len(places) - 1)] == starts + j)]
        if not len(starts):
            break
    return starts, starts + len(terms)


def find_windows(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """Per indexed text: doc_id, n_words, n_hit (words inside occurrences), items (sorted, distinct), spans of matches.

    ``slop`` 0 finds exact phrases; more lets that many other words come in between (proximity). A window is sent to the
    segments that hold its rarest term, and each segment is searched by itself, so a task holds one segment's lists
    and the windows it may contain. ``spans`` are (start, end) in words, overlapping ones merged.
    """
    totals = index.filter(F.col("term") != DIRECTORY).groupBy("term").agg(F.sum("n").alias("total"))
    numbered = windows.withColumn("window", F.xxhash64("item", "terms"))
    terms = numbered.select("window", F.explode("terms").alias("term")).distinct().join(totals, "term", "left")
    # A window with a term that no text has can't occur; else its rarest term decides.
    rarest = terms.groupBy("window").agg(
        F.count(F.when(F.col("total").isNull(), 1)).alias("missing"), F.min(F.struct("total", "term")).alias("least")
    )
    rare = numbered.join(rarest.filter("missing = 0").select("window", F.col("least.term").alias("term")), "window")
    placed = index.select(F.col("segment").alias("in_segment"), "term").join(rare, "term").select("in_segment", "item", "terms")
    asked = placed.select(F.col("in_segment").alias("segment"), F.explode("terms").alias("term")).distinct()
    postings = index.join(asked, ["segment", "term"], "left_semi").union(index.filter(F.col("term") == DIRECTORY))
    id_type = index.schema["ids"].dataType.elementType.simpleString()

    def search(lists_of: pd.DataFrame, asked_of: pd.DataFrame) -> pd.DataFrame:
        lists, sizes, ids, counts = {}, {}, [], np.zeros(0, np.int64)
        for term, n, places, own_ids in zip(lists_of["term"], lists_of["n"], lists_of["places"], lists_of["ids"], strict=True):
            if term == DIRECTORY:
                counts, ids = np.frombuffer(zlib.decompress(places), "<i4").astype(np.int64), own_ids
            else:
                lists[term], sizes[term] = _unpacked(places), n
        begins = np.concatenate([[0], np.cumsum(counts + GAP)])[:-1]
        hits: list[dict] = [{} for _ in counts]
        items: list[set] = [set() for _ in counts]
        for item, terms in zip(asked_of["item"], asked_of["terms"], strict=True):
            if not all(t in lists for t in terms):
                continue
            starts, ends = _matches(terms, lists, sizes, slop)
            for owner, start, end in zip(np.searchsorted(begins, starts, "right") - 1, starts, ends, strict=True):
                items[owner].add(item)
                start, end = int(start - begins[owner]), int(end - begins[owner])
                hits[owner][start] = max(hits[owner].get(start, 0), end)
        spans, n_hit = [], []
        for own in hits:
            merged: list[list[int]] = []
            for start, end in sorted(own.items()):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            spans.append([{"start": a, "end": b} for a, b in merged])
            n_hit.append(sum(b - a for a, b in merged))
        return pd.DataFrame({"doc_id": list(ids), "n_words": counts, "n_hit": n_hit, "items": [sorted(x) for x in items], "spans": spans})

    schema = f"doc_id {id_type}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    return postings.groupBy("segment").cogroup(placed.groupBy("in_segment")).applyInPandas(search, schema)


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document what :func:`find_windows` finds of the items' windows (item_id, text).

    Defined cases: null or empty texts have no words, items without words no windows; repeated rows and ids give a row
    each; a null id is carried; a null item_id is left out of the items but hits words; empty tables give no rows, or
    rows without hits; further columns are ignored.
    """
    windows = written(windows_of(items, width).withColumn("item", F.coalesce("item", F.lit(""))), "windows")
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    found = find_windows(build_index(docs, terms, id_col, text_col), windows)
    return found.withColumn("items", F.array_remove("items", ""))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit. Rows are matched by id and by a hash of the text."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    texts = docs.select(key.alias("__key"), F.col(text_col).alias("__text"))

    def hits() -> DataFrame:
        return contamination(texts, items, width, "__key", "__text").filter("n_hit > 0").select(F.col("doc_id").alias("__key")).distinct()

    hit = settled(hits, "hits")
    return docs.join(hit, key == hit["__key"], "left_anti")
