"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import regex


def lowered(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def invented(seed, n_words, vocabulary=400):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(2 + rnd.randrange(5))) for _ in range(n_words) if vocabulary)


class Groups:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, x, y):
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)


def near(rows, words, percent=80):
    """doc_id to (n_shingles, component id); ids must be unique."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        n = min(words, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    groups, ids = Groups(), sorted(sets)
    for k, x in enumerate(ids):
        for y in ids[:k]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                groups.link(x, y)
    return {i: (len(sets[i]), groups.find(i)) for i in ids}


TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items, width=10):
    """(n_words, n_hit, sorted item ids) of one text."""
    w, hit, found = TERM.findall(lowered(text)), set(), set()
    for item, item_text in items:
        terms = TERM.findall(lowered(item_text))
        n = min(width, len(terms))
        windows = {tuple(terms[j : j + n]) for j in range(len(terms) - n + 1)} if terms else set()
        for j in range(len(w) - n + 1) if windows else ():
            if tuple(w[j : j + n]) in windows:
                hit.update(range(j, j + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def repeated(texts, length=400):
    """Per text (bytes, removed, runs, sha of the rest)."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, sha(bytes(b for b, g in zip(d, gone, strict=True) if not g))))
    return out


def line_words(line):
    return tuple(w for w in regex.split(r"[^\p{L}\p{N}]+", line.lower()) if w)


def edit_distance(a, b, most=None):
    """Edits between two strings; any number above ``most`` where there are more."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if most is not None and min(row) > most:
            return most + 1
    return row[-1]


def _with(pairs):
    db = duckdb.connect()
    db.register("pairs", pairs)
    return db


def fuzzy_lines(rows, percent=80):
    """Per (id, text) row in order of id: the lines that stay. Every pair of lines is compared, by characters."""
    split = [[(line, line_words(line)) for line in (t or "").split("\n")] for _, t in rows]
    names = sorted({w for lines in split for _, w in lines if w})
    plain = [" ".join(w) for w in names]
    runs = [Counter(zip(p, p[1:], strict=False)) for p in plain]
    groups, near = Groups(), []
    for k, a in enumerate(plain):
        for m, b in enumerate(plain[:k]):
            most = max(len(a), len(b)) * (100 - percent) // 100
            # An edit changes two runs of two characters into two others at most.
            if abs(len(a) - len(b)) <= most and len(a) + len(b) - 2 - 2 * (runs[k] & runs[m]).total() <= 4 * most:
                near.append((k, m, a, b, most))
    pairs = pd.DataFrame(near, columns=["k", "m", "a", "b", "most"])
    for k, m in duckdb.sql("SELECT k, m FROM pairs WHERE levenshtein(a, b) <= most", connection=_with(pairs)).fetchall():
        groups.link(k, m)
    place, seen, out = {w: i for i, w in enumerate(names)}, set(), []
    for lines in split:
        kept = []
        for line, w in lines:
            group = groups.find(place[w]) if w else None
            if group is None or group not in seen:
                kept.append(line)
            seen.add(group)
        out.append(kept)
    return out
