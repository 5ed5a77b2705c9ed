"""Evaluation texts leaking into training text (problem 5), by an FM-index per training shard.

The words of an item's texts are numbered. A training shard is what a task reads, up to ``SHARD_WORDS`` words at a time: its fields
become words with the items' numbers, all other words separate, and stretches shorter than a phrase are left
out, as no phrase can lie in them. Over the rest stands an FM-index (``fmindex``). Every run of ``PHRASE`` consecutive words of
every item is searched backward at once, step by step for those still found; occurrences are located
by sampled suffix positions, and overlapping ones of an item in a field are merged to removal spans. The training side is
read once and never shuffled before the few spans are.

Items are numbered in blocks of at most ``BLOCK_WORDS`` words (or one item), each a broadcast of its own. A shard is held as words and searched
for one block after the other; of several blocks a worker has one in memory. So memory has a bound however many items there are.

Defined results: null and empty texts and items of fewer than ``PHRASE`` words match nothing; phrases don't reach over two fields or texts;
repeated rows are each reported; items with equal texts are each reported; items without an id are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .copies import slices_of
from .fmindex import FMIndex

PHRASE = 40
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 2_000_000

#: Fixed value: a word is a run of a-z and 0-9 or one character from U+4E00 to U+9FFF, after lower-casing.
_WORD = re.compile("[a-z0-9]+|[一-鿿]")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def runs_of(numbers: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of at least ``least`` numbers above 0."""
    on = np.concatenate([[0], (numbers > 0).view(np.int8), [0]])
    edge = np.flatnonzero(np.diff(on))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a >= least:
            yield a, b


class Phrases:
    """The items of one block: numbered words of all texts, and the item of each place."""

    def __init__(self, items: list[tuple[str, list[list[str]]]]):
        self.names = [name for name, _ in items]
        self.vocabulary: dict[str, int] = {}
        text, owner = [0], [0]
        for i, (_, texts) in enumerate(items):
            for part in texts:
                text += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in part] + [0]
                owner += [i] * (len(part) + 1)
        self.text, self.owner = np.array(text, np.int64), np.array(owner, np.int64)


def _search(phrases: Phrases, shard: list[np.ndarray], places: list[tuple[int, int, int]], length: int) -> list[np.ndarray]:
    """Columns (row, field, item, begin, end) of merged spans, none if there are none; ``places`` gives row, field and first word of each stretch."""
    lengths = np.fromiter(map(len, shard), np.int64, len(shard))
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    for s, stretch in zip(starts.tolist(), shard):
        text[s : s + len(stretch)] = stretch
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    end, low, high = index.matches(phrases.text, length)
    if not len(end):
        return []
    item = np.repeat(phrases.owner[end], high - low)
    # Many phrases of an item may be found at one place: each suffix is located once.
    span = np.arange(len(item)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
    unique, inverse = np.unique(span, return_inverse=True)
    at = index.locate(unique)[inverse]
    stretch = np.searchsorted(starts, at, "right") - 1
    where = np.array(places, np.int64)[stretch]
    begin = at - starts[stretch] + where[:, 2]
    order = np.lexsort((begin, where[:, 1], where[:, 0], item))
    item, where, begin = item[order], where[order], begin[order]
    # All occurrences have one length, so each reaches the next exactly if it begins no later than this one ends.
    fresh = np.concatenate([[True], (np.diff(item) != 0) | (np.diff(where[:, 0]) != 0) | (np.diff(where[:, 1]) != 0) | (np.diff(begin) > length)])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(begin)) - 1
    return [where[first, 0], where[first, 1], np.array(phrases.names, object)[item[first]], begin[first], begin[last] + length]


def _blocks(items: DataFrame, columns: list[str], length: int, most: int) -> Iterator[Phrases]:
    block: list[tuple[str, list[list[str]]]] = []
    size = 0
    for row in items.where("name is not null").select("name", *columns).toLocalIterator():
        texts = [w for w in (words(row[c]) for c in columns) if len(w) >= length]
        if texts:
            block.append((row["name"], texts))
            size += sum(map(len, texts))
        if size >= most:
            yield Phrases(block)
            block, size = [], 0
    if block:
        yield Phrases(block)


def leaked_spans(rows: DataFrame, id_column: str, fields: list[str], items: DataFrame, item_column: str, item_fields: list[str], length: int = PHRASE, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, field, item, word_begin, word_end): removal spans, in words of the field, of each item that leaked.

    ``id`` must be a bigint; spans of one item in one field don't overlap.
    """
    spark = rows.sparkSession
    read = rows.where(F.col(f"`{id_column}`").isNotNull()).select(F.col(f"`{id_column}`").alias("id"), *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)])
    names = [f"f{i}" for i in range(len(fields))]
    texts = items.select(F.col(f"`{item_column}`").alias("name"), *[F.col(f"`{f}`").alias(f"g{i}") for i, f in enumerate(item_fields)])
    schema = "id bigint, field int, item string, word_begin int, word_end int"

    blocks = [spark.sparkContext.broadcast(phrases) for phrases in _blocks(texts, [f"g{i}" for i in range(len(item_fields))], length, block_words)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, list[str]]] = []
        size = 0

        def found() -> Iterator[pa.RecordBatch]:
            for sent in blocks:
                phrases: Phrases = sent.value
                number = phrases.vocabulary.get
                shard: list[np.ndarray] = []
                places: list[tuple[int, int, int]] = []
                for i, f, text in held:
                    numbers = np.fromiter((number(w, 0) for w in text), np.int64, len(text))
                    for a, b in runs_of(numbers, length):
                        shard.append(numbers[a:b])
                        places.append((i, f, a))
                spans = _search(phrases, shard, places, length) if shard else []
                if spans:
                    yield pa.RecordBatch.from_arrays([pa.array(s, t) for s, t in zip(spans, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()))], names=["id", "field", "item", "word_begin", "word_end"])
                if len(blocks) > 1:
                    del phrases, number
                    sent.__dict__.pop("_value", None)  # the worker's copy; it is read again from its file

        for part in slices_of(batches, names):
            ids = part.column("id").to_pylist()
            for f, name in enumerate(names):
                for i, text in zip(ids, part.column(name).to_pylist()):
                    own = words(text)
                    if len(own) >= length:
                        held.append((i, f, own))
                        size += len(own)
            if size >= shard_words:
                yield from found()
                held, size = [], 0
        if held:
            yield from found()

    found = materialize(read.mapInArrow(run, schema), "leaks") if blocks else spark.createDataFrame([], schema)
    field = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(i), F.lit(f))])
    return found.select(F.col("id").alias(id_column), field[F.col("field")].alias("field"), "item", "word_begin", "word_end")


def leaked_items(spans: DataFrame, id_column: str) -> DataFrame:
    """(id, item, words): each row and item once, with the number of leaked words over all fields."""
    return spans.groupBy(id_column, "item").agg(F.sum(F.col("word_end") - F.col("word_begin")).alias("words"))


def leak_report(spans: DataFrame, id_column: str) -> DataFrame:
    """(item, rows, words, longest) of each item that leaked."""
    size = F.col("word_end") - F.col("word_begin")
    return spans.groupBy("item", id_column).agg(F.sum(size).alias("w"), F.max(size).alias("m")).groupBy("item").agg(F.count("*").alias("rows"), F.sum("w").alias("words"), F.max("m").alias("longest"))
