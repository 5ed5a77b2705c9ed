"""Byte-level BPE of a whole corpus with a public vocabulary (problem 6).

A text is cut by the vocabulary's fixed pattern into words, a word into bytes, and in each word the
leftmost pair of least rank is merged until none is left. The pairs stand in a segment tree over the
word's byte positions whose root is the leftmost minimum: a merge changes three leaves (the pair that
begins here, the one before it, and the one that vanishes), each a logarithmic walk to the root. Live
neighbours are linked lists. Trees of words of like size are the rows of one NumPy array, so one step
merges once in thousands of words; long words have a scalar tree of the same form.

Defined results: a null and an empty text both have no ids; strings that look like special tokens are
ordinary text; equal texts have equal ids; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batching import text_slices

#: Where the public vocabularies lie by default, and the pattern that splits text before merging.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same on text that is all ASCII, where the standard engine is faster. \x1c to \x1f are no white space here.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"""

_WORDS = regex.compile(PATTERN).findall
_ASCII_WORDS = re.compile(ASCII_PATTERN).findall
_NONE = np.int64(2**62)
_SCALAR_FROM = 256
_MOST_WORDS = 800_000


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, by the published rule: printable Latin-1 bytes
    stand for themselves, the others take the code points from 256 on, in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class BytePairEncoder:
    """The merges of one vocabulary file, and the words that were encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        self.byte_id = np.zeros(256, np.int64)
        for symbol, byte in _byte_symbols().items():
            self.byte_id[byte] = vocabulary[symbol]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.scalar_rank: dict[int, int] = {}
        self.forget()

    def forget(self) -> None:
        self.index: _Words = _Words()
        self.flat = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it isn't a merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lengths == 1):
            out[i] = self.byte_id[list(words[i])].astype(np.int32)
        for i in np.flatnonzero(lengths >= _SCALAR_FROM):
            out[i] = self._scalar(words[i])
        width = 2
        while width <= _SCALAR_FROM:
            rows = np.flatnonzero((lengths > max(1, width // 2)) & (lengths <= width) & (lengths < _SCALAR_FROM))
            step = max(1, 262_144 // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._trees([words[i] for i in part], lengths[part], width)):
                    out[i] = ids
            width *= 2
        return out

    def _trees(self, words: list[bytes], lengths: np.ndarray, width: int) -> list[np.ndarray]:
        """Ids of words of at most ``width`` bytes (a power of two), a row of trees each."""
        count = len(words)
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(count, width)
        at = np.arange(width)
        ids = np.zeros((count, width + 1), np.int64)
        ids[:, :width] = self.byte_id[text]
        live = at[None, :] < lengths[:, None]
        after = np.tile(np.arange(1, width + 2), (count, 1))
        after[:, :width][at[None, :] + 1 >= lengths[:, None]] = width
        before = np.tile(np.arange(-1, width), (count, 1))
        tree = np.full((count, 2 * width), _NONE, np.int64)
        paired = at[None, : width - 1] + 1 < lengths[:, None]
        rank = self.rank(ids[:, : width - 1], ids[:, 1:width])
        tree[:, width : 2 * width - 1] = np.where(paired & (rank < _NONE), rank * width + at[None, : width - 1], _NONE)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            least = tree[rows, 1]
            here = least % width
            gone = after[rows, here]
            follows = after[rows, gone]
            ids[rows, here] = self.merged[least // width]
            live[rows, gone] = False
            after[rows, here] = follows
            before[rows, follows] = here
            tree[rows, width + gone] = _NONE
            self._leaf(tree, rows, here, ids[rows, here], ids[rows, follows], follows < width, width)
            previous = before[rows, here]
            self._leaf(tree, rows, np.maximum(previous, 0), ids[rows, np.maximum(previous, 0)], ids[rows, here], previous >= 0, width, keep=True)
            for leaf in (gone, here, np.maximum(previous, 0)):
                node = width + leaf
                for _ in range(width.bit_length() - 1):
                    node = node >> 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            rows = rows[tree[rows, 1] < _NONE]
        flat = ids[:, :width][live].astype(np.int32)
        return np.split(flat, np.cumsum(live.sum(1))[:-1])

    def _leaf(self, tree, rows, at, left, right, paired, width, keep=False) -> None:
        rank = self.rank(left, right)
        value = np.where(paired & (rank < _NONE), rank * width + at, _NONE)
        if keep:
            value = np.where(paired, value, tree[rows, width + at])
        tree[rows, width + at] = value

    def _scalar(self, word: bytes) -> np.ndarray:
        """The same tree for one long word."""
        if not self.scalar_rank:
            self.scalar_rank = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        rank_of, merged, none = self.scalar_rank.get, self.merged, int(_NONE)
        n = len(word)
        width = 1 << (n - 1).bit_length()
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = rank_of(ids[i] << 32 | ids[i + 1], none)
            tree[width + i] = r * width + i if r < none else none
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        def pair(i: int) -> int:
            j = after[i]
            r = rank_of(ids[i] << 32 | ids[j], none) if j < n else none
            return r * width + i if r < none else none

        while (least := tree[1]) < none:
            rank, i = divmod(least, width)
            gone = after[i]
            ids[i] = int(merged[rank])
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            put(gone, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return np.array(out, np.int32)

    def lookup(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For all words of the texts their index among the words known, and the number of words of each text."""
        if len(self.index) > _MOST_WORDS:
            self.forget()
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = _ASCII_WORDS(text) if text.isascii() else _WORDS(text)
                counts[i] = len(found)
                words += found
        known = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            encoded = self.encode_words([w.encode("utf-8", "replace") for w in self.index.new])
            self.index.new = []
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, *encoded])
        return known, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the offsets at which each text's begin (one more than texts)."""
        known, counts = self.lookup(texts)
        lengths = self.lengths[known]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[known] - ends + lengths, lengths) + np.arange(total)]
        ends = np.concatenate([[0], ends])
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def token_counts(self, texts: list[str | None]) -> np.ndarray:
        known, counts = self.lookup(texts)
        ends = np.concatenate([[0], np.cumsum(self.lengths[known])])
        return np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


class _Words(dict):
    """Word to its index; words not met before are listed in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        self.new.append(word)
        return value


@lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    """One encoder per worker and vocabulary: its words serve all partitions that the worker runs."""
    return BytePairEncoder(path)


def vocabulary_path(tokenizers: str | None = None, name: str = VOCABULARY) -> str:
    return os.path.join(tokenizers or TOKENIZERS, name)


def token_ids(df: DataFrame, id_column: str, text_column: str, tokenizers: str | None = None) -> DataFrame:
    """(id, ids): one row per row of ``df``; no shuffle, whole texts."""
    path = vocabulary_path(tokenizers)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for part in text_slices(batches, "x"):
            ids, offsets = model.encode(part.column("x").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("i"), lists], names=["i", "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(f"`{id_column}`").alias("i"), F.col(f"`{text_column}`").alias("x"))
    return rows.mapInArrow(run, f"i {kind}, ids array<int>").select(F.col("i").alias(id_column), "ids")


def token_counts(df: DataFrame, id_column: str, text_column: str, tokenizers: str | None = None) -> DataFrame:
    """(id, n_tokens): the length of each text's ids, without making the lists."""
    path = vocabulary_path(tokenizers)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for part in text_slices(batches, "x"):
            counts = model.token_counts(part.column("x").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(counts, pa.int64())], names=["i", "n_tokens"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(f"`{id_column}`").alias("i"), F.col(f"`{text_column}`").alias("x"))
    return rows.mapInArrow(run, f"i {kind}, n_tokens bigint").select(F.col("i").alias(id_column), "n_tokens")
