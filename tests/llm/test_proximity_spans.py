"""Items, spans and hit words of proximity matches against brute force, phrases at the beginning of texts among them."""

import random

import brute
import pytest

from shelfscope.llm import decontaminate


def _brute(text, phrases, slop):
    words, items, inside = brute.TERM.findall(text), set(), set()
    for item, phrase in phrases:
        terms = phrase.split(" ")
        for start in (i for i, w in enumerate(words) if w == terms[0]):
            last = start
            for term in terms[1:]:
                last = next((i for i in range(last + 1, len(words)) if words[i] == term), None)
                if last is None:
                    break
            if last is not None and last - start < len(terms) + slop:
                items.add(str(item))
                inside.update(range(start, last + 1))
    spans = []
    for i in sorted(inside):
        if spans and spans[-1][1] == i:
            spans[-1][1] = i + 1
        else:
            spans.append([i, i + 1])
    return sorted(items), spans, len(inside)


@pytest.mark.parametrize("slop", [0, 1, 2, 5])
def test_items_spans_and_hits(spark, slop):
    rnd = random.Random(slop)
    phrases = [(1, "alpha beta gamma"), (2, "beta beta"), (3, "delta"), (4, "gamma x alpha")]
    texts = ["alpha beta gamma", "x y", "beta beta alpha", "", "alpha x beta y gamma x", "alpha beta gamma"]
    texts += [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "x", "y"]) for _ in range(rnd.randrange(12))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    windows = decontaminate.windows_of(spark.createDataFrame(phrases, "item_id long, text string"))
    found = decontaminate.find_windows(decontaminate.build_index(rows), windows, slop).collect()
    got = {r.doc_id: (r["items"], [[s.start, s.end] for s in r.spans], r.n_hit) for r in found}
    assert got == {i: _brute(t, phrases, slop) for i, t in enumerate(texts)}
