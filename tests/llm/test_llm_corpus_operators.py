"""Operators over the whole corpus: decontamination, near duplicates, shards, repeated strings, lines; the pipeline."""

import random
import re
import zlib
from collections import Counter

import brute
import duckdb
import pytest

import corpus_pipeline
from shelfscope.llm import decontaminate, line_dedup, near_dedup, sharding, suffix_dedup
from shelfscope.llm.components import components
from shelfscope.llm.queries import QUERIES, SQL

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One line."), (4, "One line."), (None, "No id here."), (6, "long " * 20_000), (7, "éü ß\n\nzwei")]


def docs(spark, rows):
    """(doc_id, text) rows, with columns that are also names inside the operators."""
    schema = "doc_id long, text string, `key` int, row string, n int, text_key long, line_key long, pos int, root long, segment long, copies int"
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, 6, 7, 8) for r in rows], schema)


def edited(text, seed, changes):
    rnd, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
    return " ".join(words)


# components


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(7, 7), (200, 900), (900, 200)]
    groups = brute.Groups()
    for a, b in edges:
        groups.link(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: groups.find(n) for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# decontamination


def test_contamination(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["the", "of", "Été", "x1", "zeta", "Beta", "rho", "tau"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 4, 9, 10, 11, 25])))) for i in range(12)] + [(90, None), (91, "!!"), (None, "null id item")]
    rows = [*ODD] + [(10 + i, ", ".join(word() for _ in range(60)) + " " + (items[i % 12][1] or "").upper()) for i in range(40)] + [(80, "say null ID-item"), (81, "rho")]
    table = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, terms string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs(spark, rows), table).collect())
    assert got == Counter((i, *(tuple(x) if isinstance(x, list) else x for x in brute.contamination(t, items))) for i, t in rows)


def test_all_terms_are_indexed_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_TERMS_SENT", 1)
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs(spark, [(1, "zero one two three"), (2, "one three two")]), items).collect()}
    assert got == {1: 3, 2: 0}


def test_proximity(spark):
    rows = docs(spark, [(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "alpha x y beta gamma"), (4, "beta alpha gamma"), (5, "alpha x beta y gamma")])
    windows = decontaminate.windows_of(spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string"))
    index = decontaminate.build_index(rows)
    for slop, expected in ((0, {1}), (1, {1, 2}), (2, {1, 2, 3, 5})):
        assert {r.doc_id for r in decontaminate.find_windows(index, windows, slop).filter("n_hit > 0").collect()} == expected


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs(spark, []), none).count() == 0
    assert decontaminate.contamination(docs(spark, ODD), none).filter("n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(docs(spark, ODD), none).count() == len(ODD)


# near duplicates


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    base = [brute.invented(s, 120) for s in range(6)]
    rows = [(1, None), (2, ""), (3, "One"), (4, "one"), (5, "one two"), (6, " \n ")]
    rows += [(10 + i, edited(base[i % 6], i, i % 9)) for i in range(60)] + [(100 + i, base[0].upper() + " \n") for i in range(5)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, rows), near_dedup.MinHash(words=words)).collect()}
    assert got == brute.near(rows, words)


def test_near_duplicates_across_a_chain(spark):
    text = brute.invented(9, 200).split(" ")
    rows = []
    for i in range(30):  # neighbours are near, ends are far apart
        rows.append((1000 - i, " ".join(text)))
        for j in range(5):
            text[(i * 5 + j) % 200] = f"new{i}x{j}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, rows), near_dedup.MinHash(words=2)).collect()}
    assert got == brute.near(rows, 2) and {c for _, c in got.values()} == {971}


def test_one_of_each_group_stays(spark):
    rows = [*ODD, (4, "one LINE."), (None, "no id here."), (9, "no id here."), (10, "alone it stands")]
    kept = near_dedup.drop_near_duplicates(docs(spark, rows)).collect()
    texts = Counter((r.text or "").strip().lower() for r in kept)
    assert texts["one line."] == texts["no id here."] == texts["alone it stands"] == 1
    assert [r.doc_id for r in kept if (r.text or "").lower() == "no id here."] == [9]
    assert {r.doc_id for r in kept if not (r.text or "").strip()} == {1, 2, 3}
    assert near_dedup.drop_near_duplicates(docs(spark, [])).count() == 0


# shards


def test_shards(spark):
    rows = [*ODD] + [(50 + i // 3, "y" * (i % 17)) for i in range(200)]
    found = sharding.balanced_shards(docs(spark, rows), 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    place = sorted(found, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in place]
    assert ids == sorted(ids)
    for shard, own in Counter(r.shard for r in found).items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(own))
    assert sharding.balanced_shards(docs(spark, []), 4).count() == 0


def test_shards_are_balanced(spark, sf):
    found = QUERIES["op7_sharding"](spark, sf).collect()
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert set(sizes) == set(range(16)) and {r.law for r in found} == {"bytes"} and {r.grown_shard for r in found} == {None}
    assert max(abs(s - sum(sizes.values()) / 16) for s in sizes.values()) <= max(r.size for r in found)


# repeated strings


def test_repeated_strings(spark):
    rnd = random.Random(6)
    shared = [brute.invented(s, 150) for s in range(5)]
    rows = [(i, t) for i, t in ODD if i != 6]
    for i in range(40):
        start, end = sorted(rnd.randrange(len(shared[i % 5])) for _ in range(2))
        rows.append((10 + i, brute.invented(100 + i, 20 + i) + shared[i % 5][start:end] + "é" * (i % 4) + brute.invented(200 + i, 30)))
    # exactly 399, 400 and 401 shared bytes, periodic text, a repeat inside one text, copies, overlaps
    for n, lead in ((399, "p"), (400, "q"), (401, "r")):
        own = brute.invented(300 + n, 200)[:n]
        rows += [(n, lead + own + "1" + brute.invented(n, 9)), (n + 50, brute.invented(n + 1, 9) + "2" + own + "3")]
    rows += [(600, "ab" * 400), (601, "=" * 1000), (602, "x" + "=" * 450), (603, shared[0] + "|" + shared[0]), (604, shared[1]), (604, shared[1]), (605, shared[1])]
    found = suffix_dedup.repeated_spans(docs(spark, rows)).collect()
    got = Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in found)
    assert got == Counter((i, *x) for (i, _), x in zip(rows, brute.repeated([t for _, t in rows]), strict=True))
    assert suffix_dedup.repeated_spans(docs(spark, [])).count() == 0


# lines


def test_fuzzy_lines(spark):
    rnd = random.Random(8)
    pool = [brute.invented(s, 25 + s % 40) for s in range(12)] + ["Of.", "", "  ", "...", "Ünï cödé"]
    rows = [(i, "\n".join(edited(rnd.choice(pool), rnd.randrange(99), rnd.randrange(2)).capitalize() for _ in range(rnd.randrange(6)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " ".join(f"w{i}" for i in range(40_000))), (53, "x\n" * 300)]
    found = sorted(line_dedup.deduplicated_lines(docs(spark, rows)).select("row.doc_id", "n_lines", "n_removed", "clean_text").collect())
    for (i, text), kept, got in zip(rows, brute.fuzzy_lines(rows), found, strict=True):
        n = len((text or "").split("\n"))
        assert tuple(got) == (i, n, n - len(kept), "\n".join(kept))


def test_equal_rows_and_null_ids(spark):
    rows = [(4, "One line.\n\nTwo"), (4, "One line.\n\nTwo"), (None, "two\nthree"), (9, "THREE!")]
    kept = sorted((r.doc_id or 0, r.text) for r in line_dedup.drop_repeated_lines(docs(spark, rows)).collect())
    assert kept == [(4, "One line.\n\nTwo"), (9, "THREE!")]
    assert line_dedup.drop_repeated_lines(docs(spark, [])).count() == 0


def test_line_plan_has_no_python(spark, sf):
    assert not re.search("Python|Pandas|Arrow", QUERIES["op9_line_dedup"](spark, sf)._jdf.queryExecution().toString())


# queries against SQL, and the pipeline


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    theirs = db.execute(SQL[name])
    columns = sorted(c[0] for c in theirs.description)
    order = [[c[0] for c in theirs.description].index(c) for c in columns]
    theirs = Counter(tuple(r[i] for i in order) for r in theirs.fetchall())
    mine = QUERIES[name](spark, sf)
    assert sorted(mine.columns) == columns
    assert Counter(map(tuple, mine.select(*columns).collect())) == theirs


def test_pipeline(spark, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs_in, stages = given, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near", "decontamination", "tokens"]
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_in = stage(spark, docs_in, sf)
        rows = docs_in.collect()
        assert docs_in.columns == given.columns
        docs_in = spark.createDataFrame(rows, given.schema)
        after[name] = sorted((r.doc_id, r.text) for r in rows)
        assert all(r.n_chars == len(r.text) for r in rows)
    expected = [(i, "\n".join(kept)) for (i, _), kept in zip(after["quality"], brute.fuzzy_lines(after["quality"]), strict=True)]
    assert after["lines"] == [(i, t) for i, t in expected if brute.line_words(t)]
    component = brute.near(after["lines"], 5)
    assert after["near"] == [(i, t) for i, t in after["lines"] if component[i][1] == i]
    assert after["decontamination"] == [(i, t) for i, t in after["near"] if not brute.contamination(t, items)[1]]
    final = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.text) for r in final) == after["decontamination"]
