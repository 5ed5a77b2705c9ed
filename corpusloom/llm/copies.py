"""Exact copies as classes, and fixed-size hash filters: what several operators of this subpackage start with."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Bits of a filter at least (4 MB) and at most (128 MB); a fuller filter lets more rows pass and never loses one.
FILTER_BITS, MOST_FILTER_BITS = 1 << 25, 1 << 30
#: Bits for each hash, as long as the bound allows: at two bits set, one in 70 other hashes passes.
BITS_PER_HASH = 16
_WORD_BITS = 6
_BLOCK_BITS = 13


def distinct_texts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t, id, x) of one representative per class of equal texts, and (t, rep, id) of all records; from (t, id, x).

    Digests are grouped with partial aggregation, so a class of any size costs one row per input partition. Copies are then left
    out of the scan by their ids, which Spark broadcasts only below its size threshold.
    """
    keyed = materialize(texts.where("x is not null and id is not null").select("t", "id", F.md5(F.col("x").cast("binary")).alias("digest")), "digests")
    classes = keyed.groupBy("t", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members = materialize(keyed.join(classes, ["t", "digest"]).select("t", "rep", "id"), "members")
    # A table of its own, so that its size is known when the join is planned.
    copies = materialize(members.where("id <> rep").select("t", "id"), "copies")
    return texts.join(copies, ["t", "id"], "left_anti"), members


def class_pairs(members: DataFrame, keys: list[str], block: int = 1_000) -> DataFrame:
    """(keys..., a, b), a < b: all pairs of the members (keys..., id) of each class.

    A class of more than ``block`` members is dealt to blocks, and each two blocks meet in a group of their own, so no class of any size
    is the work of one task.
    """
    sized = members.join(members.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), keys)
    own = sized.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    left = own.select(*keys, F.col("id").alias("a"), F.col("_own").alias("_l"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_r"))
    right = own.select(*keys, F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_l"), F.col("_own").alias("_r"))
    return left.join(right, [*keys, "_l", "_r"]).where("a < b").select(*keys, "a", "b")


def filter_bits(hashes: int) -> int:
    """Bits of a filter for so many hashes: a power of two within the bounds."""
    return max(FILTER_BITS, min(MOST_FILTER_BITS, 1 << max(0, BITS_PER_HASH * hashes - 1).bit_length()))


def hash_filter(hashes: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap of two bits per hash, as 64-bit words; its size is fixed by ``bits`` alone.

    Bits are combined to words before the shuffle, words to dense blocks after it; the driver gets bits / 8 bytes at most.
    """
    mask, shift = bits - 1, bits.bit_length() - 1
    each = hashes.select(F.explode(F.array(F.col(column).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(column, shift).bitwiseAND(F.lit(mask)))).alias("bit"))
    words = each.groupBy(F.shiftright("bit", _WORD_BITS).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(bit & {(1 << _WORD_BITS) - 1} as int))")).alias("set"))

    def dense(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            word, value = batch.column("word").to_numpy(), batch.column("set").to_numpy()
            for block in np.unique(word >> _BLOCK_BITS).tolist():
                own = word >> _BLOCK_BITS == block
                blocks.setdefault(block, np.zeros(1 << _BLOCK_BITS, np.int64))[word[own] & (1 << _BLOCK_BITS) - 1] = value[own]
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([v.tobytes() for v in blocks.values()], pa.binary())], names=["block", "words"])

    count = max(1, bits >> _WORD_BITS + _BLOCK_BITS)
    table = words.repartition(min(8, count), F.shiftright("word", _BLOCK_BITS)).mapInArrow(dense, "block int, words binary").toArrow()
    out = np.zeros((count, 1 << _BLOCK_BITS), np.uint64)
    for block, value in zip(table.column("block").to_pylist(), table.column("words").to_pylist()):
        out[block] = np.frombuffer(value, np.uint64)
    return out.ravel()[: bits >> _WORD_BITS]


def passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be in the filter."""
    bits = len(words) << _WORD_BITS
    mask, shift, low = np.uint64(bits - 1), np.uint64(bits.bit_length() - 1), np.uint64((1 << _WORD_BITS) - 1)

    def on(at: np.ndarray) -> np.ndarray:
        return (words[at >> np.uint64(_WORD_BITS)] >> (at & low)) & np.uint64(1) != 0

    found = on(hashes & mask)
    some = np.flatnonzero(found)
    found[some] = on((hashes[some] >> shift) & mask)
    return found


def slices_of(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Slices small in every text column of ``columns``."""
    from .batching import text_slices

    for column in columns:
        batches = text_slices(batches, column)
    yield from batches
