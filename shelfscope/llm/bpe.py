"""BPE as an automaton: merges are compiled one by one into a table of allowed token pairs, words are encoded by table.

Compiling starts from one state in which every byte may follow every byte. The gadget of a merge (a, b) -> c lets c be
read wherever a may be read, leads it where b leads, and forbids b right after a. Tokens that lead to the same state
share a row, tokens that may be read in the same states share a column; a merge splits at most one of each. What is
left in the end accepts, for every byte string, exactly the token sequence of the merge procedure, so the token in
which a prefix ends is found from the table alone: the longest suffix token that may follow the token before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pattern of the byte-level pre-tokenizer; its white space is the Unicode property.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CACHED_WORDS = 200_000  # words whose codes a worker remembers; beyond that the memory is emptied, never a result
WAVE = 50_000  # new words encoded together


def byte_of_char() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class PairTable:
    """States, columns and the packed table of allowed (state, column) pairs."""

    def __init__(self, n_tokens: int, merges: list[tuple[int, int, int]], n_bytes: int) -> None:
        state, column = [0] * n_tokens, [0] * n_tokens
        of_state, of_column = [n_bytes], [n_bytes]  # tokens that share each
        steps: list[tuple[int, int, int, int]] = []  # row copied, column copied (-1: none), pair forbidden
        for a, b, c in merges:
            state[c] = state[b]
            of_state[state[b]] += 1
            if a != b:
                column[c] = column[a]
                of_column[column[a]] += 1
            row = col = -1
            if of_state[state[a]] > 1:
                row = state[a]
                of_state[row] -= 1
                state[a] = len(of_state)
                of_state.append(1)
            if of_column[column[b]] > 1:
                col = column[b]
                of_column[col] -= 1
                column[b] = len(of_column)
                of_column.append(1)
            steps.append((row, col, state[a], column[b]))
            if a == b:  # after a no a may be read any more, so no c either
                column[c] = column[a]
                of_column[column[a]] += 1
        self.state, self.column = np.array(state, np.int32), np.array(column, np.int32)
        bits = np.zeros((len(of_state), -(-len(of_column) // 8)), np.uint8)
        bits[0, 0] = 1
        for row, col, s, k in steps:
            if row >= 0:
                bits[s] = bits[row]
            if col >= 0:
                bits[:, k >> 3] |= ((bits[:, col >> 3] >> (col & 7)) & 1) << (k & 7)
            bits[s, k >> 3] &= ~(1 << (k & 7)) & 255
        self.bits = bits

    def allows(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether ``token`` may follow ``before``; -1 stands for the start of a word."""
        column = self.column[token]
        bit = self.bits[self.state[np.maximum(before, 0)], column >> 3] >> (column & 7).astype(np.uint8)
        return (bit & 1).astype(bool) | (before < 0)


class Automaton:
    """The compiled vocabulary: a suffix automaton over bytes that names tokens, and the pair table."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = byte_of_char()
        vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = arc_labels(path)
        self.pairs = PairTable(len(self.token_bytes), [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], len(as_byte))
        self.length = np.array([len(t) for t in self.token_bytes], np.int32)
        self._compile_bytes(vocab.values())
        self.added_split = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.codes: dict[str, bytes] = {}

    def _compile_bytes(self, tokens) -> None:
        """Trie of the tokens with failure arcs filled in; ``longest``: token at a node, ``shorter``: its next suffix token."""
        children: list[dict[int, int]] = [{}]
        own: list[int] = [-1]
        for i in tokens:
            at = 0
            for b in self.token_bytes[i]:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    own.append(-1)
                at = children[at][b]
            own[at] = i
        inner = [i for i, c in enumerate(children) if c]
        self.row = np.zeros(len(children), np.int32)  # a node without children steps like the node that it fails to
        self.row[inner] = np.arange(len(inner))
        self.go = np.zeros((len(inner), 256), np.int32)
        self.longest = np.array(own, np.int32)
        self.shorter = np.full(len(self.token_bytes), -1, np.int32)
        fail = np.zeros(len(children), np.int32)
        for b, child in children[0].items():
            self.go[0, b] = child
        level = list(children[0].values())
        while level:
            deeper = []
            for node in level:
                back = fail[node]
                if own[node] < 0:
                    self.longest[node] = self.longest[back]
                elif node != 0:
                    self.shorter[own[node]] = self.longest[back]
                if not children[node]:
                    self.row[node] = self.row[back]
                    continue
                row, outer = self.row[node], self.row[back]
                self.go[row] = self.go[outer]
                for b, child in children[node].items():
                    fail[child] = self.go[outer, b]
                    self.go[row, b] = child
                    deeper.append(child)
            level = deeper

    def _ends(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of the joined words the token in which the code of the prefix up to there ends; word starts."""
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        data = np.frombuffer(b"".join(words), np.uint8)
        last = np.empty(len(data), np.int32)
        alive = np.argsort(-lengths, kind="stable")
        sorted_lengths = lengths[alive]
        node = np.zeros(len(words), np.int32)
        for i in range(int(lengths.max(initial=0))):
            k = int(np.searchsorted(-sorted_lengths, -i))  # words longer than i
            at = starts[alive[:k]]
            node = self.go[self.row[node[:k]], data[at + i]]
            token = self.longest[node]
            open_ = np.arange(k)
            while len(open_):
                t = token[open_]
                back = i - self.length[t]
                before = np.where(back >= 0, last[at[open_] + np.maximum(back, 0)], -1)
                wrong = ~self.pairs.allows(before, t)
                open_ = open_[wrong]
                token[open_] = self.shorter[token[open_]]
            last[at + i] = token
        return last, starts

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids of non-empty words as int32 bytes, by table steps over all words at once."""
        last, starts = self._ends(words)
        n = len(words)
        at = starts + np.array([len(w) for w in words], np.int64) - 1
        open_, found = np.arange(n), []
        while len(open_):  # from the end of each word backwards
            t = last[at[open_]]
            found.append((open_, t))
            at[open_] -= self.length[t]
            open_ = open_[at[open_] >= starts[open_]]
        owner = np.concatenate([o for o, _ in found][::-1])
        ids = np.concatenate([t for _, t in found][::-1])
        order = np.argsort(owner, kind="stable")  # last steps come first, so the order in a word is from its start
        packed = ids[order].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=n))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def pieces(self, text: str) -> list[str]:
        """Pre-split words; texts of added tokens stand alone."""
        if not self.added_split or not any(a in text for a in self.added):
            return SPLIT.findall(text)
        out: list[str] = []
        for part in self.added_split.split(text):
            out += [part] if part in self.added else SPLIT.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text. New words are encoded in waves, known ones looked up."""
        split = [self.pieces(t) for t in texts]
        if len(self.codes) > CACHED_WORDS:
            self.codes.clear()
        codes = self.codes
        if not codes:
            codes.update({name: np.array([i], "<i4").tobytes() for name, i in self.added.items()})
        new = list(set().union(*split).difference(codes))
        for i in range(0, len(new), WAVE):
            wave = new[i : i + WAVE]
            codes.update(zip(wave, self.encode_words([w.encode() for w in wave]), strict=True))
        return [np.frombuffer(b"".join(map(codes.__getitem__, words)), "<i4") for words in split]



def spelled(ids: list[int], labels: list[bytes]) -> str:
    """The labels of the arcs one after the other, as text; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def arc_labels(path: str) -> list[bytes]:
    """The bytes of each token of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    as_byte = byte_of_char()
    named = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
    added = {t["id"] for t in spec["added_tokens"]}
    labels = [b""] * (max(named.values()) + 1)
    for name, i in named.items():
        labels[i] = name.encode() if i in added else bytes(as_byte[ch] for ch in name)
    return labels


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """One table a worker and file."""
    return Automaton(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", spell: bool = False) -> DataFrame:
    """``doc_id`` and ``ids``: the token ids of the whole text. ``path``: vocabulary file, the same on every executor.
    ``spell`` adds ``text``, decoded from the ids in the same pass.

    Row-wise, no shuffle. A worker compiles the table once (about 80 MB) and remembers at most ``CACHED_WORDS`` codes.

    Defined cases: a null or empty text has no ids; null and repeated ids keep a row each; an empty table gives no
    rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch):
                codes = automaton(path).encode([t or "" for t in part.column(1).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(codes)))]
                if spell:
                    columns.append(pa.array([spelled(c.tolist(), arc_labels(path)) for c in codes], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", text string" * spell
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) plus ``text``, the text that the ids spell; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [spelled(row.values.to_pylist(), arc_labels(path)) if row.is_valid else None for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def _portions(batch: pa.RecordBatch, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many bytes of text, so that very long texts don't pile up."""
    sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)])
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop

