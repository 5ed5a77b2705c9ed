"""Overlapping chunks of token counts: closed form, coverage, statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import CODE_TOKEN


def chunk_starts(tokens: Column, size: int, overlap: int, least: int) -> Column:
    """Starts of the chunks of a document; none for a document shorter than ``least``."""
    last = F.greatest(tokens - overlap - 1, F.lit(0))
    return F.when(tokens >= least, F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(size - overlap).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def chunk_spans(df: DataFrame, key: str, tokens: str, size: int = 512, overlap: int = 64, least: int = 64) -> DataFrame:
    """(key, chunk_index, token_start, token_end): one row per chunk, narrow."""
    n = F.col(tokens).cast("bigint")
    each = df.select(F.col(key), n.alias("_n"), F.posexplode(chunk_starts(n, size, overlap, least)).alias("chunk_index", "token_start"))
    return each.select(key, "chunk_index", "token_start", F.least(F.col("token_start") + size, F.col("_n")).alias("token_end"))


def covered(spans: Column, begin: str = "token_start", end: str = "token_end") -> Column:
    """Length of the union of the spans in an array of structs with the fields ``begin`` and ``end``, in any order."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s[begin].cast("bigint").alias("a"), s[end].cast("bigint").alias("b"))))
    zero = F.lit(0).cast("bigint")

    def step(state: Column, span: Column) -> Column:
        return F.struct(F.greatest(state["upto"], span["b"]).alias("upto"), (state["sum"] + F.greatest(zero, span["b"] - F.greatest(span["a"], state["upto"]))).alias("sum"))

    return F.aggregate(ordered, F.struct(zero.alias("upto"), zero.alias("sum")), step, lambda s: s["sum"])


def chunk_statistics(df: DataFrame, tokens: str, by: list[str] = (), size: int = 512, overlap: int = 64, least: int = 64) -> DataFrame:
    """(by..., documents, tokens, chunks, full, partial, emitted, covered, extra), from token counts without making chunks."""
    n = F.col(tokens).cast("bigint")
    starts = chunk_starts(n, size, overlap, least)
    ends = F.transform(starts, lambda s: F.least(s + size, n))
    emitted = F.aggregate(F.arrays_zip(starts.alias("a"), ends.alias("b")), F.lit(0).cast("bigint"), lambda acc, z: acc + z["b"] - z["a"])
    full = F.size(F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: z["b"] - z["a"] == size))
    each = df.select(*by, n.alias("n"), F.size(starts).alias("c"), emitted.alias("e"), full.alias("f"), F.when(n >= least, n).otherwise(0).alias("v"))
    return each.groupBy(*by).agg(F.count("n").alias("documents"), F.sum("n").alias("tokens"), F.sum("c").alias("chunks"), F.sum("f").alias("full"), F.sum(F.col("c") - F.col("f")).alias("partial"), F.sum("e").alias("emitted"), F.sum("v").alias("covered"), F.sum(F.col("e") - F.col("v")).alias("extra"))


def chunk_texts(df: DataFrame, key: str, text: str, size: int = 512, overlap: int = 64, least: int = 64) -> DataFrame:
    """(key, chunk_index, token_start, token_end, text): chunks as stretches of the text as it is, by token offsets; narrow."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for k, x in zip(part.column("k").to_pylist(), part.column("x").to_pylist()):
                    spans = [m.span() for m in CODE_TOKEN.finditer(x)]
                    n = len(spans)
                    if n >= least:
                        rows += [(k, i, a, min(a + size, n), x[spans[a][0] : spans[min(a + size, n) - 1][1]]) for i, a in enumerate(range(0, max(n - overlap - 1, 0) + 1, size - overlap))]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (part.column("k").type, pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["k", "chunk_index", "token_start", "token_end", "text"])

    read = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("x"))
    return read.mapInArrow(run, f"k {kind}, chunk_index int, token_start int, token_end int, text string").withColumnRenamed("k", key)
