"""Passages of over 50 words that repeat across documents, against brute force; what isn't repeated stays whole."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from shelfscope.llm import suffix_dedup


def _text(rnd, n_words, letters):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(letters)) for _ in range(n_words))


@pytest.mark.parametrize("letters", [4, 6, 12])  # 60 words of 299, 419 and 779 bytes
def test_planted_passages(spark, letters):
    rnd = random.Random(letters)
    passage = _text(rnd, 60, letters)
    clean = [_text(rnd, rnd.randrange(80, 300), 5) for _ in range(20)]
    planted = [f"{_text(rnd, rnd.randrange(0, 200), 5)} {passage} {_text(rnd, rnd.randrange(0, 200), 5)}" for _ in range(20)]
    texts = [t for pair in zip(clean, planted, strict=True) for t in pair]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s.end - s.start)
    found = suffix_dedup.repeated_spans(rows).select("doc_id", "n_bytes", removed, F.size("spans"), "kept_sha256").collect()
    got = {r[0]: tuple(r[1:]) for r in found}
    assert got == dict(enumerate(brute.repeated(texts)))
    assert all(got[i][1] == 0 for i in range(0, 40, 2))
    assert all((got[i][1] >= len(passage)) == (len(passage) >= 400) for i in range(1, 40, 2))


def test_one_passage_in_most_of_the_rows(spark):
    rnd = random.Random(3)
    passage = _text(rnd, 120, 5)
    texts = [passage * 2 if i % 9 == 0 else f"{_text(rnd, 40, 5)} {passage}" for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.kept_sha256 for r in suffix_dedup.repeated_spans(rows).collect()}
    assert got == {i: x[3] for i, x in enumerate(brute.repeated(texts))}
