"""Near-duplicate documents: b-bit MinHash signatures, a multi-index join on chunks, exact confirmation on full sets.

A signature holds ``chunks * chunk_size`` min-hashes of ``bits`` bits. Two signatures that differ in at most
``chunks * (errors + 1) - 1`` places have a chunk with ``errors`` differences at most (pigeonhole), so leaving out every
choice of ``errors`` places of every chunk gives them a key in common. With the defaults that covers 23 of 60 places;
a pair with similarity 0.8 differs in 12 on average and finds no common key once in ten million.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm import word_hash
from shelfscope.llm.components import components
from shelfscope.llm.scratch import settled, written

NOT_SPACE = word_hash.letters(" \t\n\u000b\f\r")
LANES = 4  # 16-bit places in a long
PARITY_BITS = 512


@dataclass(frozen=True)
class MinHash:
    """``words``: words in a shingle. ``percent``: least similarity. ``most_apart``: differing places beyond which a pair
    with a key in common is not looked at; at similarity 0.8 one pair in 10**9 is that far apart."""

    words: int = 5
    percent: int = 80
    chunks: int = 12
    chunk_size: int = 5
    errors: int = 1
    most_apart: int = 32

    @property
    def places(self) -> int:
        return self.chunks * self.chunk_size

    @property
    def signature_columns(self) -> list[str]:
        return [f"s{i}" for i in range(self.places // LANES)]

    @property
    def columns(self) -> list[str]:
        """Of a signed class: the signature and the parity sketch."""
        return [*self.signature_columns, *[f"p{i}" for i in range(PARITY_BITS // 64)]]

    @cached_property
    def multipliers(self) -> np.ndarray:
        return word_hash.mix(np.arange(1, self.places + 1, dtype=np.uint64)) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Smallest value of each multiply-hash over the shingles, cut to 16 bits."""
        least = np.full(self.places, np.iinfo(np.uint64).max)
        for i in range(0, len(shingles), 1 << 14):
            np.minimum(least, (shingles[i : i + (1 << 14), None] * self.multipliers).min(axis=0), out=least)
        return (word_hash.mix(least) & np.uint64(0xFFFF)).astype("<u2")

    @staticmethod
    def parity(shingles: np.ndarray) -> np.ndarray:
        """For each of PARITY_BITS cells whether an odd number of shingles fall into it. Two sets differ in at least as
        many elements as their sketches differ in bits, which rules pairs out without a doubt and without the sets."""
        cells = np.bincount((word_hash.mix(shingles ^ word_hash.BASE) >> np.uint64(55)).astype(np.int64), minlength=PARITY_BITS)
        return np.packbits((cells & 1).astype(bool)).view("<i8")

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """Per signature (a row of 16-bit places) the keys under which it can be found."""
        found = []
        for chunk in range(self.chunks):
            own = signatures[:, chunk * self.chunk_size : (chunk + 1) * self.chunk_size].astype(np.uint64)
            for out, left in enumerate(combinations(range(self.chunk_size), self.chunk_size - self.errors)):
                key = np.full(len(own), chunk * 1000 + out, np.uint64)
                for place in left:
                    key = word_hash.mix(key * word_hash.BASE + own[:, place])
                found.append(key)
        return np.stack(found, axis=1).view(np.int64)


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text."""
    for first, stop, data, offsets in word_hash.portions(column):
        hashes, at = word_hash.words(data, offsets, NOT_SPACE)
        for i in range(stop - first):
            yield np.unique(word_hash.shingles(hashes[at[i] : at[i + 1]], size))


@lru_cache(maxsize=64)
def _set_of(text: str, size: int) -> np.ndarray:
    """One set; the pairs of a class come one after the other, so its set is mostly at hand."""
    return next(_sets(pa.array([text], pa.string()), size))


def _signed(docs: DataFrame, rule: MinHash) -> DataFrame:
    """doc_id, text_key, n_shingles, class_id (equal for equal shingle sets; null without words) and the signature."""
    names = rule.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sums, signatures, parities = [], [], [], []
            for own in _sets(batch.column(2), rule.words):
                n.append(len(own))
                sums.append((word_hash.mix(own).sum(dtype=np.uint64), word_hash.mix(own ^ word_hash.BASE).sum(dtype=np.uint64)))
                signatures.append(rule.signature(own))
                parities.append(rule.parity(own))
            counts, sums = np.array(n, np.uint64), np.array(sums, np.uint64).reshape(len(n), 2)
            ids = word_hash.mix(sums[:, 0] * np.uint64(3) ^ word_hash.mix(sums[:, 1] + counts)).view(np.int64)
            packed = np.array(signatures, "<u2").reshape(len(n), rule.places).view("<i8")
            packed = np.concatenate([packed, np.array(parities, "<i8").reshape(len(n), PARITY_BITS // 64)], axis=1)
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, mask=counts == 0)]
            columns += [pa.array(np.ascontiguousarray(packed[:, i])) for i in range(packed.shape[1])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "class_id", *names])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text_key long, n_shingles long, class_id long, " + ", ".join(f"{c} long" for c in names)
    return written(docs.select("doc_id", "text_key", "text").mapInArrow(run, schema), "signatures")


def _keyed(classes: DataFrame, rule: MinHash) -> DataFrame:
    """(key, class_id), a row for each key of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                packed = np.stack([part.column(i + 1).to_numpy() for i in range(len(rule.signature_columns))], axis=1)
                keys = rule.keys(np.ascontiguousarray(packed).view("<u2"))
                owners = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(owners)], ["key", "class_id"])

    return classes.select("class_id", *rule.signature_columns).mapInArrow(run, "key long, class_id long")


def _places_apart(rule: MinHash) -> Column:
    """In how many 16-bit places the signatures x.* and y.* differ."""
    total = F.lit(0)
    for c in rule.signature_columns:
        d = F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))
        for shift, mask in ((8, 0x00FF00FF00FF00FF), (4, 0x000F000F000F000F), (2, 0x0003000300030003), (1, 0x0001000100010001)):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift)).bitwiseAND(F.lit(mask))
        total = total + F.bit_count(d)
    return total


def _may_be_near(rule: MinHash) -> Column:
    """Whether the classes x.* and y.* can't be ruled out: by size, by parity (both certain) and by signature."""
    sizes, differ = F.col("x.n_shingles") + F.col("y.n_shingles"), F.lit(0)
    for c in rule.columns[len(rule.signature_columns) :]:
        differ = differ + F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")))
    return (
        (F.least("x.n_shingles", "y.n_shingles") * 100 >= F.greatest("x.n_shingles", "y.n_shingles") * rule.percent)
        & (differ * (100 + rule.percent) <= sizes * (100 - rule.percent))
        & (_places_apart(rule) <= rule.most_apart)
    )


def _confirmed(pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], rule: MinHash) -> DataFrame:
    """Of distinct candidate (a, b) those whose full shingle sets are similar enough. ``texts_of``: (class_id) to texts."""
    near = written(pairs, "near-pairs")
    texts = texts_of(near.select(F.col("a").alias("class_id")).union(near.select("b")).distinct())
    both = near.join(texts.select(F.col("class_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("class_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = _set_of(a.as_py(), rule.words), _set_of(b.as_py(), rule.words)
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(100 * common >= rule.percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, rule: MinHash | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, text_key (64-bit hash of the text), n_shingles, root (a name of the component, null
    without words), component_id (its smallest doc_id) and kept.

    Rows with equal shingle sets are one class, so copies never meet each other. Classes that share a key are first
    compared with the smallest and the largest class of the key only. What that leaves unlinked - classes of one key
    in different components - is compared inside the join, and pairs come out of it only if neither sizes nor sketches
    rule them out: no link between components is lost, and no group that is linked already is expanded. Every link is
    confirmed on whole shingle sets.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is
    one shingle. Defined cases: null or empty texts have no shingles and are linked with nothing; a null id counts as
    no id (a component without any has a null component_id); repeated ids are separate rows that share their id; an
    empty table gives no rows; further columns are ignored.
    """
    rule = rule or MinHash()
    text = F.col(text_col)
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    signed = _signed(docs, rule)
    own = signed.filter("class_id IS NOT NULL").groupBy("class_id")
    classes = written(
        own.agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), *[F.first(c).alias(c) for c in rule.columns]),
        "classes",
    )
    # What is joined with a possibly hot key is written first: both sides are then plain exchanges, whose hot
    # partitions adaptive execution splits.

    def with_ends() -> DataFrame:
        keys = written(_keyed(classes, rule), "keys")
        shared = keys.groupBy("key").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).filter("lo < hi")
        return keys.join(written(shared, "shared-keys"), "key")

    members = settled(with_ends, "members")

    def texts_of(wanted: DataFrame) -> DataFrame:
        places = wanted.join(classes.select("class_id", "least_id"), "class_id")
        rows = signed.join(places, "class_id").filter(F.col("doc_id").eqNullSafe(F.col("least_id"))).groupBy("class_id").agg(
            F.first("doc_id").alias("doc_id"), F.min("text_key").alias("text_key")
        )
        found = docs.alias("d").join(rows.alias("r"), (F.col("d.text_key") == F.col("r.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")))
        return written(found.select("r.class_id", "d.text").dropDuplicates(["class_id"]), "class-texts")

    stars = members.select("class_id", F.explode(F.array("lo", "hi")).alias("centre")).filter("class_id <> centre")
    stars = stars.select(F.least("class_id", "centre").alias("a"), F.greatest("class_id", "centre").alias("b")).distinct()
    near = stars.join(classes.alias("x"), F.col("a") == F.col("x.class_id")).join(
        classes.alias("y"), (F.col("b") == F.col("y.class_id")) & _may_be_near(rule)
    )
    links = settled(lambda: _confirmed(near.select("a", "b"), texts_of, rule), "links")
    roots = settled(lambda: components(links), "roots")

    def open_classes() -> DataFrame:
        placed = members.select("key", "class_id").join(roots, members["class_id"] == roots["node"], "left")
        placed = written(placed.select("key", "class_id", F.coalesce("root", "class_id").alias("root")), "placed")
        mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
        open_ = written(placed.join(written(mixed, "mixed-keys"), "key"), "open-members")
        own_keys = open_.groupBy("class_id", "root").agg(F.collect_set("key").alias("keys"))  # a class has a fixed number
        described = own_keys.join(classes.select("class_id", "n_shingles", *rule.columns), "class_id")
        return described.withColumn("key", F.explode("keys"))

    open_ = settled(open_classes, "open-classes")
    apart = open_.alias("x").join(
        open_.alias("y"),
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.root") < F.col("y.root"))
        & _may_be_near(rule)
        & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")),  # once a pair, not once a key
    )
    apart = apart.select(F.least("x.class_id", "y.class_id").alias("a"), F.greatest("x.class_id", "y.class_id").alias("b"))
    more = settled(lambda: _confirmed(apart, texts_of, rule), "links")
    roots = settled(lambda: components(links.union(more)), "roots")

    grouped = classes.join(roots, classes["class_id"] == roots["node"], "left").select(
        "class_id", "least_id", F.coalesce("root", "class_id").alias("root")
    )
    least = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    component = grouped.join(least, "root").select("class_id", "root", "component_id")
    placed = signed.select("doc_id", "text_key", "n_shingles", "class_id").join(component, "class_id", "left")
    component_id = F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return placed.select(
        "doc_id", "text_key", "n_shingles", "root", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, rule: MinHash | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates, in the columns of ``docs``: the one with the smallest id.

    Of rows that share that id one stays. Documents without words stay, each for itself.
    """

    def firsts() -> DataFrame:
        judged = near_duplicates(docs, rule, id_col, text_col).filter("kept AND root IS NOT NULL")
        return judged.groupBy("root").agg(F.min("doc_id").alias("__id"), F.min("text_key").alias("__key"), F.count(F.lit(1)).alias("__n"))

    worded = settled(firsts, "firsts")
    key = F.xxhash64(F.col(text_col))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (key == F.col("__key"))
    found = docs.join(worded, same).select(*[docs[c] for c in docs.columns], "__key", "__n")
    single = found.filter("__n = 1").select(*docs.columns)
    several = found.filter("__n > 1").dropDuplicates([id_col, "__key"]).select(*docs.columns)
    has_word = F.coalesce(F.length(F.btrim(F.col(text_col), F.lit(" \t\n\u000b\f\r"))), F.lit(0)) > 0
    return single.union(several).union(docs.filter(~has_word))
