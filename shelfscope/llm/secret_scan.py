"""Secret scan: fixed patterns, plus strings in sensitive context that zstandard can't predict from the code around."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns: kind, expression, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # a run is taken whole either way
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "novel")
# Names that code is full of: what they predict is no secret.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key client_secret private_key authorization bearer credential "
    "config settings environment production development localhost example default username database connection "
    "self.assertEqual function return import export public static const string value request response session "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ https://www.example.com/path/index.html"
)
SENSITIVE = re.compile(r"pass|secret|token|key|auth|cred|bearer|private|signature|cookie|session|login|account", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# A value of any characters: quoted, or all that follows ":" or "=" up to a space.
VALUE = re.compile(r"""(?:"([^"\n]{8,})"|'([^'\n]{8,})'|(?<![\w.-])[\w.-]++["']?[\x20\t]*+[:=][\x20\t]*([^\s"'][^\s"',;]{7,}))""", re.A)
BLOCK = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]+-----")
ALPHABETS = ("0123456789", "abcdef", "ABCDEF", "ghijklmnopqrstuvwxyz", "GHIJKLMNOPQRSTUVWXYZ")


@dataclass(frozen=True)
class Novelty:
    """``context``: characters on each side that prime the compressor. ``lines``: lines before its own on which a sensitive
    word may stand if it has its line to itself, ``before``: characters of each of them that are looked at; a BEGIN line counts up to its END line.
    ``least_bytes``: marginal compressed bytes of a candidate, ``short_bytes`` of a value of mixed characters.
    ``least_share``: marginal bytes as a share of those that as many random characters of the same alphabet take."""

    context: int = 400
    before: int = 200
    lines: int = 2
    least_bytes: int = 14
    short_bytes: int = 7
    least_share: float = 0.75


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; per kind leftmost and without overlap, short ones dropped."""
    found = []
    low = text.lower()
    for kind, (name, pattern, group, least) in enumerate(BASE):
        if name == "assign" and not any(w in low for w in ASSIGN_WORDS):
            continue
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


def _size(data: bytes, primer: bytes) -> int:
    primed = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(packer.compress(data))


def marginal_bytes(candidate: str, around: str) -> int:
    """Compressed bytes that the candidate adds to its line end, given the names and the code around it."""
    primer = (IDENTIFIERS + " " + around).encode("utf-8", "replace")
    lead = around[-16:].encode("utf-8", "replace")
    return _size(lead + candidate.encode("utf-8", "replace"), primer) - _size(lead, primer)


@lru_cache(maxsize=4096)
def _random_bytes(alphabet: str, length: int) -> int:
    return marginal_bytes("".join(random.Random(length).choices(alphabet, k=length)), " ")


def random_bytes(word: str) -> int:
    """Marginal bytes of a random string that is as long as ``word`` and of the same kinds of characters."""
    kinds = set(word)
    classes = [chars for chars in ALPHABETS if not kinds.isdisjoint(chars)]
    return _random_bytes("".join([*classes, *sorted(c for c in kinds if not (c.isascii() and c.isalnum()))]), len(word))


def _kinds(word: str) -> int:
    return any(map(str.isdigit, word)) + any(map(str.islower, word)) + any(map(str.isupper, word)) + any(not c.isalnum() for c in word)


def _candidates(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it is a value of mixed characters) of the strings to be scored, by start."""
    values = []
    for m in VALUE.finditer(text):
        start, end = m.span(m.lastindex)
        word = text[start:end]
        if _kinds(word) >= 3 and not any(map(str.isspace, word)) and not CANDIDATE.fullmatch(word):
            values.append((start, end, True))
    taken = iter(values)
    value = next(taken, None)
    for m in CANDIDATE.finditer(text):
        while value and value[1] <= m.start():
            yield value
            value = next(taken, None)
        if not value or m.end() <= value[0]:
            yield (*m.span(), False)
        elif not (value[0] <= m.start() and m.end() <= value[1]):
            yield (*m.span(), False)
            value = next(taken, None)
    if value:
        yield value
        yield from taken


def _is_sensitive(text: str, start: int, blocks: list[tuple[int, int]], rules: Novelty) -> bool:
    if any(a <= start < b for a, b in blocks):
        return True
    stop = start
    for _ in range(rules.lines + 1):
        begin = max(text.rfind("\n", 0, stop) + 1, stop - rules.before)
        if SENSITIVE.search(text, begin, stop):
            return True
        if stop == start and any(map(str.isalnum, text[begin:stop])):
            return False
        stop = text.rfind("\n", 0, stop)
        if stop < 0:
            return False
    return False


def novel_spans(text: str, rules: Novelty) -> list[tuple[int, int, int]]:
    """(start, kind, end) of strings in sensitive context that the primer doesn't predict."""
    found = []
    if not SENSITIVE.search(text) and "-----BEGIN " not in text:
        return found
    marks = [(m.start(), m.end(), m[1]) for m in BLOCK.finditer(text)]
    blocks = [
        (m[1], following[0])
        for m, following in zip(marks, [*marks[1:], (len(text), len(text), "END")], strict=False)
        if m[2] == "BEGIN" and SENSITIVE.search(text[m[0] : m[1]])
    ]
    for start, end, mixed in _candidates(text):
        word = text[start:end]
        if mixed:
            if len(set(word)) < 6:
                continue
        elif len(set(word)) < 8 or not (any(c.isdigit() for c in word) or word.lower() != word and word[1:].lower() != word[1:]):
            continue
        if not _is_sensitive(text, start, blocks, rules):
            continue
        around = text[end : end + rules.context] + " " + text[max(0, start - rules.context) : start]
        least = max(rules.short_bytes if mixed else rules.least_bytes, rules.least_share * random_bytes(word))
        if marginal_bytes(word, around) >= least:
            found.append((start, len(BASE), end))
    return found


def find_secrets(docs: DataFrame, rules: Novelty | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``, an array of (kind, start, end) by start and then kind, in code points.

    One pass without a shuffle; a text is scanned whole. Priming costs a few compressions for each candidate only.

    Defined cases: a null or empty text has no spans; null and repeated ids keep a row each; equal spans of different
    kinds are all kept; an empty table gives no rows; further columns are ignored.
    """
    rules = rules or Novelty()
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for text in batch.column(1):
                text = text.as_py() or ""
                found = sorted(base_spans(text) + novel_spans(text, rules))
                spans.append([{"kind": KINDS[k], "start": start, "end": end} for start, k, end in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")
