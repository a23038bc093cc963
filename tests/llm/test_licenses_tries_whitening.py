"""Licence scan, conversation trie and whitening against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from shelfscope.llm import license_scan, prefix_trie, whitening
from shelfscope.llm.queries import QUERIES

SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()


# licences


def docs(spark, rows):
    """(doc_id, text) rows, with columns that are also names inside the operator."""
    schema = "doc_id long, text string, word string, at int, start int, template int, mask long, label string, row string, text_key long, n_words int"
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, "y", "z", 5, 6) for r in rows], schema)


def scanned(texts, index):
    """Per text (n_words, n_base, first, last, base labels, labels, score), by looking at every start."""
    words = [brute.TERM.findall(brute.lowered(t)) for t in texts]
    frequency = Counter(w for own in words for w in set(own))
    out = []
    for own in words:
        base = [(p, label) for phrase, label in index.base.items() for p in license_scan._places(phrase.split(), own)]
        labels, score = {label for _, label in base}, 0.0
        for t in index.templates:
            notice = license_scan.plain_words(t.text)
            distinct = sorted(set(notice), key=lambda w: (frequency[w], w))
            rare = distinct[: max(1, min(index.rare, len(distinct) // 2))]
            items = [(p - place, w) for w in rare for place, x in enumerate(notice) if x == w for p, y in enumerate(own) if y == w]
            for phrase in t.phrases:
                for place in license_scan._places(phrase.split(), notice):
                    items += [(p - place, phrase) for p in license_scan._places(phrase.split(), own)]
            for shift in (0, index.width // 2):
                buckets = defaultdict(set)
                for start, item in items:
                    buckets[(start + shift) // index.width].add(item)
                for found in buckets.values():
                    agree = len(found & set(rare) - set(t.phrases))
                    if set(t.phrases) <= found and 100 * agree >= index.need_percent * len(rare):
                        labels.add(t.label)
                        score = max(score, agree / len(rare))
        at = sorted(p for p, _ in base)
        out.append((len(own), len(base), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score))
    return out


def test_licenses(spark):
    rnd, index = random.Random(2), license_scan.LicenseIndex()
    filler = lambda n: " ".join(rnd.choice(["the", "of", "and", "to", "permission", "software", "zeta", "rho", "is"]) for _ in range(n))
    texts = [None, "", " \n", "Of.", "license " * 20_000, "mit license, MIT-License; general public\nlicense", "mit licenses", "the mit", "éü license mit license"]
    for t in index.templates:
        body = t.text.replace(" ", "\n * ") if len(t.text) > 90 else t.text
        texts += [filler(40) + " " + body.upper() + " " + filler(30), filler(9) + t.text[: len(t.text) // 2], t.text.replace("this", "that")]
    mit, gpl = index.templates[0].text, next(t.text for t in index.templates if t.name == "gpl")
    texts += [f"{mit} {filler(200)} {gpl}", mit + mit, "word " * 500 + gpl, filler(3000)]
    rows = list(enumerate(texts)) + [(None, mit), (5, texts[5]), (5, texts[5])]
    found = license_scan.scan_licenses(docs(spark, rows)).collect()
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    got = Counter((r.doc_id, *(r[c] for c in columns)) for r in found)
    expected = scanned([t for _, t in rows], index)
    assert got == Counter((i, *x) for (i, _), x in zip(rows, expected, strict=True))
    by_id = {r.doc_id: r for r in found}
    for k, t in enumerate(index.templates):
        assert t.label in by_id[9 + 3 * k].labels.split(","), t.name
    both = by_id[9 + 3 * len(index.templates)]
    assert set(both.labels.split(",")) == {"mit", "gpl"} and {s.template for s in both.spans} >= {"mit", "gpl"}
    start = {s.template: s.start for s in both.spans}
    assert start["mit"] == 0 and brute.TERM.findall(brute.lowered(texts[both.doc_id]))[start["gpl"]] == "this"


def test_licenses_of_nothing_and_plan(spark, sf):
    assert license_scan.scan_licenses(docs(spark, [])).count() == 0
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", QUERIES["op11_license_scan"](spark, sf)._jdf.queryExecution().toString())


# conversations


def rebuilt(rows, family=5, most=9):
    """conv_id to its list of (role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - int(math.fmod(c, family)), [])[:h] + turns[h:]
    return out


def trie(sequences):
    """Rows of the trie of id to turns."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    out = []
    for node, inside in members.items():
        below = [x for x in members if x[: len(node)] == node]
        inner = {x[:-1] for x in members if x}
        out.append((
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), sum(len(x) == len(node) + 1 for x in below),
            sum(x not in inner for x in below), sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x),
            SHA(",".join(map(str, sorted(ends[node])))),
        ))
    return Counter(out)


def said(seed):
    """Many conversations with shared openings, copies, gaps, ties and odd values."""
    rnd, rows = random.Random(seed), []
    for c in range(-6, 120):
        if c % 11 == 3:
            continue
        depth = rnd.choice([0, 1, 2, 3, 9, 14]) if c % 4 else 12
        for t in range(depth):
            text = f"é{c % 7 if t < 6 else c}" if c % 4 else "same again"
            rows.append((c, t if t else None, rnd.choice(["user", "user", "system"]) if c % 4 else "user", None if text == "é3" else text))
    rows += [(200, 1, None, "x"), (200, 1, "", "x"), (200, 1, "a", "b"), (200, None, "z", ""), (None, 1, "user", "no conversation"), (5000, 0, "user", "alone")]
    return rows


def talk(spark, rows):
    """Conversations with columns that are also names inside the operator."""
    schema = "conv_id long, turn long, role string, text string, node int, base int, head int, size int, path string, level int"
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x", 5) for r in rows], schema)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("most_turns", [10**6, 40, 6, 1])
def test_trie(spark, most_turns, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEVELS", 2)
    rows = said(4)
    found = prefix_trie.prefix_trie(prefix_trie.branched_sequences(talk(spark, rows)), most_turns)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in found.collect()) == trie(rebuilt(rows))


def test_trie_of_few(spark):
    assert prefix_trie.prefix_trie(prefix_trie.branched_sequences(talk(spark, []))).count() == 0
    # no conversation 5, so 6 keeps what it has after its first h turns: nothing
    one = prefix_trie.prefix_trie(prefix_trie.branched_sequences(talk(spark, [(6, 0, "user", "x")]))).collect()
    expected = trie(rebuilt([(6, 0, "user", "x")]))
    assert Counter(tuple(r[c] for c in COLUMNS) for r in one) == expected


def test_digest_of_an_end_that_many_share(spark, monkeypatch):
    """Ids of one end over several tasks and several pieces of each."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    ids = list(range(-5, 400))
    random.Random(1).shuffle(ids)
    rows = [(b"a", i) for i in ids] + [(b"b", 3), (b"c", 1), (b"c", 12), (b"d", 9)]
    given = spark.createDataFrame(rows, "end binary, conv_id long").repartition(5)
    got = {bytes(r.end): r.ends_sha256 for r in prefix_trie._end_digests(given).collect()}
    assert got == {b"a": SHA(",".join(map(str, sorted(ids)))), b"b": SHA("3"), b"c": SHA("1,12"), b"d": SHA("9")}


def test_long_conversation(spark):
    rows = [(0, t, "user", f"t{t % 97}") for t in range(30_000)] + [(1, t, "user", f"t{t % 97}") for t in range(20)]
    found = prefix_trie.prefix_trie(prefix_trie.branched_sequences(talk(spark, rows)))
    assert found.count() == 30_001 and found.agg({"n_convs": "max"}).first()[0] == 2


# whitening


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<float>, cell int, row string, x int")


def answers(data):
    """(n, deviations, eigenvalues, axes, trace) by the covariance in whole numbers and a dense solver."""
    x = np.floor(64 * np.asarray(data, np.float32).astype(float)).astype(int).tolist()
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    y = np.array(x) - np.array(sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return n, deviations, values[::-1], axes[:, ::-1], values.sum(), y


@pytest.mark.parametrize("width, n", [(64, 700), (48, 90), (5, 30), (80, 60)])
def test_whitening(spark, width, n):
    rng = np.random.default_rng(width)
    data = rng.standard_normal((n, width)) * (0.3 + rng.random(width)) * 4 + 9
    odd = [(-1, None), (-2, []), (-3, [1.0] * (width + 1)), (-4, [float("nan")] + [0.0] * (width - 1)), (-5, [float("inf")] + [0.0] * (width - 1)), (-6, [None] * width)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)] + odd
    found = whitening.whiten(vectors(spark, rows)).select("row.vec_id", "*").collect()
    n, deviations, values, axes, trace, y = answers(data)
    k = min(32, int((values[:32] > values[0] * 1e-12).sum()))
    assert Counter((r.vec_id, r.component) for r in found) == Counter((i, c) for i in range(n) for c in range(1, k + 1))
    got = np.zeros((n, k))
    for r in found:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and int(r.deviation) == deviations[r.vec_id] and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-10)
    expected = y @ axes[:, :k] / np.sqrt(values[:k])
    sign = np.sign((got * expected).sum(axis=0))
    assert np.abs(got - sign * expected).max() < 1e-7


def test_vectors_that_do_not_differ(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).count() == 0
    line = whitening.whiten(vectors(spark, [(1, [1.0, 1e38]), (1, [1.0, -1e38]), (None, [1.0, 0.0])])).collect()
    assert len(line) == 3 and {r.component for r in line} == {1}


def test_deviations_beyond_machine_words():
    x, shift = np.array([[1 << 40, -(1 << 40)], [3, 4]]), np.array([7, -9])
    n = 10**6
    assert whitening._deviations(x, n, shift) == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, shift, strict=True)) for r in x.tolist()]
