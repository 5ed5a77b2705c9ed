"""Long exact spans shared between documents (problem 8), by super-k-mer partitioning.

A window is ``LENGTH`` consecutive code points; two documents share a span of that length exactly if they have a window in
common. The minimiser of a window is the least hash of its runs of ``MINIMISER`` code points, so equal windows
have equal minimisers. Consecutive windows with one minimiser are a super-k-mer. A first pass counts in how many documents
each minimiser occurs (partial aggregation); a minimiser of one document can't be shared, and what is repeated goes
into a filter of bounded size. A second pass sends the super-k-mers that pass it, each packed as one string, to the
minimiser's bucket, where their windows are sorted by hash, and equal hashes of different documents are compared as strings.

Documents that have a window in common are a class, named by two independent hashes, each combined over its members, so that classes
with the same members are one, wherever they are found. Results are (class, member) rows; ``expand`` alone makes pairs of them.

Skew. Copies of whole texts are one class, compared once. A minimiser as long as half a window keeps boilerplate that is
shorter than that out of common buckets. A bucket is dealt by document to as many parts as it has ``PART`` documents. Windows of a
bucket of several parts also leave one row per part, named by the digest of their string; parts are combined by that name,
and as no document is in two parts, so are the names of classes. Any number of documents passes through parts of one size.

Defined results: null, empty and short texts share nothing; repeated rows are copies and share all of a
text that is long enough; a stretch that occurs twice in one document only isn't shared; lengths count code points, white space included.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import mix
from ..session import materialize
from .batching import text_slices
from .copies import class_pairs, distinct_texts, filter_bits, hash_filter, passes

LENGTH = 200
MINIMISER = 100
#: Documents in a part of a bucket, about; windows that a worker holds at a time, unless one part has more.
PART, _WINDOWS = 4_000, 250_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_NAMES = (np.uint64(1), np.uint64(1 << 40))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def rolling(points: np.ndarray, *widths: int) -> list[np.ndarray]:
    """For each width the mixed polynomial hash of every run of that many code points."""
    n = len(points)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
    back = _powers(_INVERSE, n)
    return [mix((sums[w:] - sums[:-w]) * back[: n - w + 1]) if n >= w else np.empty(0, np.uint64) for w in widths]


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    step, row = 1, values
    while 2 * step <= width:
        row = np.minimum(row[:-step], row[step:])
        step *= 2
    return np.minimum(row[: len(values) - width + 1], row[width - step :])


def super_kmers(points: np.ndarray, length: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, last window) of each run of windows with one minimiser."""
    if len(points) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    least = sliding_minimum(rolling(points, minimiser)[0], length - minimiser + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[first], first, np.append(first[1:], len(least)) - 1


def _minimisers(texts: DataFrame, length: int, minimiser: int) -> DataFrame:
    """(m): each minimiser of each text once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "x"):
            found = [np.unique(super_kmers(code_points(x), length, minimiser)[0]) for x in part.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["m"])

    return texts.select("x").mapInArrow(run, "m bigint")


def _packed(texts: DataFrame, words, length: int, minimiser: int) -> DataFrame:
    """(m, id, at, s): super-k-mers whose minimiser passes the filter; ``at`` is where the string begins."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = words.value
        for part in text_slices(batches, "x"):
            keys, ids, starts, strings = [], [], [], []
            for i, text in zip(part.column("id").to_pylist(), part.column("x").to_pylist()):
                least, first, last = super_kmers(code_points(text), length, minimiser)
                on = np.flatnonzero(passes(bits, least))
                keys.append(least[on])
                ids += [i] * len(on)
                starts.append(first[on])
                strings += [text[a : b + length] for a, b in zip(first[on].tolist(), last[on].tolist())]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids, pa.int64()), pa.array(np.concatenate(starts), pa.int32()), pa.array(strings, pa.string())], names=["m", "id", "at", "s"])

    return texts.select("id", "x").mapInArrow(run, "m bigint, id bigint, at int, s string")


#: What a bucket's part leaves: members of classes, spans, and the windows of buckets of several parts.
_MEMBER, _SPAN, _OPEN = 0, 1, 2
_FOUND = "kind tinyint, s0 bigint, s1 bigint, id bigint, begin int, end int, k0 bigint, k1 bigint, n int"


def _rows(kind: int, size: int, **columns: np.ndarray) -> pa.RecordBatch:
    names = [part.split()[0] for part in _FOUND.split(", ")]
    types = [{"tinyint": pa.int8(), "bigint": pa.int64(), "int": pa.int32()}[part.split()[1]] for part in _FOUND.split(", ")]
    columns["kind"] = np.full(size, kind, np.int8)
    signed = {c: v.view(np.int64) if v.dtype == np.uint64 else v for c, v in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(signed[c]).cast(t) if c in signed else pa.nulls(size, t) for c, t in zip(names, types)], names=names)


def _same(points: np.ndarray, p: np.ndarray, q: np.ndarray, length: int) -> bool:
    """Whether the windows at ``p`` (ascending) are all equal to those at ``q``.

    Where both go on by one place, a window is equal if the one before is and its last code point is.
    """
    if not np.array_equal(points[p + length - 1], points[q + length - 1]):
        return False
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (np.diff(q) != 1)]))
    step = np.arange(length)
    for k in range(0, len(heads), 20_000):
        some = heads[k : k + 20_000, None]
        if not np.array_equal(points[p[some] + step], points[q[some] + step]):
            return False
    return True


def _shared_windows(ids: np.ndarray, starts: np.ndarray, several: np.ndarray, strings: list[str], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole parts of buckets; ``several`` tells of each string whether its bucket has more parts."""
    by_id = np.argsort(ids, kind="stable")
    ids, starts, several, strings = ids[by_id], starts[by_id], several[by_id], [strings[k] for k in by_id.tolist()]
    points = code_points("".join(strings))
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(strings)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    flat = (np.cumsum(sizes) - sizes)[row] + within
    h = rolling(points, length)[0][flat]
    order = np.argsort(h, kind="stable")  # documents stay in order
    new = np.concatenate([[True], np.diff(h[order]) != 0])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    doc = ids[row[order]]
    shared = doc[first] != doc[last]
    group = np.cumsum(new) - 1
    on = np.flatnonzero(shared[group])
    leader = order[first[group[on]]]
    ascending = np.argsort(order[on])
    if len(on) and not _same(points, flat[order[on]][ascending], flat[leader][ascending], length):
        # Different windows with one hash: the strings themselves tell them apart.
        names: dict[str, int] = {}
        number = np.fromiter((names.setdefault(strings[r][w : w + length], len(names)) for r, w in zip(row.tolist(), within.tolist())), np.int64, len(row))
        order = np.argsort(number, kind="stable")
        new = np.concatenate([[True], np.diff(number[order]) != 0])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(order)) - 1
        doc = ids[row[order]]
        shared = doc[first] != doc[last]
        group = np.cumsum(new) - 1
    # Spans: runs of shared windows within one string.
    marked = np.zeros(len(row), bool)
    marked[order[shared[group]]] = True
    if marked.any():
        apart = np.diff(row) != 0
        open_at = np.flatnonzero(marked & np.concatenate([[True], ~marked[:-1] | apart]))
        close_at = np.flatnonzero(marked & np.concatenate([~marked[1:] | apart, [True]]))
        yield _rows(_SPAN, len(open_at), id=ids[row[open_at]], begin=starts[row[open_at]] + within[open_at], end=starts[row[close_at]] + within[close_at] + length)
    # A document counts once for a window.
    once = new | np.concatenate([[True], np.diff(doc) != 0])
    named = [np.bitwise_xor.reduceat(np.where(once, mix(doc.astype(np.uint64) + c), np.uint64(0)), first) for c in _NAMES]
    size = np.add.reduceat(once.astype(np.int32), first)
    classes = np.flatnonzero(shared)
    if len(classes):
        _, kept = np.unique(np.stack([named[0][classes], named[1][classes]], axis=1), axis=0, return_index=True)
        wanted = np.zeros(len(first), bool)
        wanted[classes[kept]] = True
        at = np.flatnonzero(once & wanted[group])
        yield _rows(_MEMBER, len(at), s0=named[0][group[at]], s1=named[1][group[at]], id=doc[at])
    # Windows that other parts may have too: one row per class; all places of those of one document, of which one counts.
    open_at = np.flatnonzero(several[row[order]] & (new | ~shared[group]))
    for k in range(0, len(open_at), 100_000):
        at = open_at[k : k + 100_000]
        g, w = group[at], order[at]
        keys = np.array([divmod(xxhash.xxh3_128_intdigest(strings[r][i : i + length].encode("utf-8", "surrogatepass")), 1 << 64) for r, i in zip(row[w].tolist(), within[w].tolist())], np.uint64)
        counts_once, alone = new[at], ~shared[g]
        place = (starts[row[w]] + within[w]).astype(np.int32)
        yield _rows(
            _OPEN, len(at), s0=np.where(counts_once, named[0][g], np.uint64(0)), s1=np.where(counts_once, named[1][g], np.uint64(0)), n=np.where(counts_once, size[g], 0).astype(np.int32),
            k0=keys[:, 0], k1=keys[:, 1], id=doc[at], begin=np.where(alone, place, -1), end=np.where(alone, place + length, -1),
        )


def _bucketed(packed: DataFrame, length: int) -> DataFrame:
    """Rows of ``_FOUND`` of super-k-mers (m, part, parts, id, at, s), part by part of each bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            yield from _shared_windows(table.column("id").to_numpy(), table.column("at").to_numpy(), table.column("parts").to_numpy() > 1, table.column("s").to_pylist(), length)

        held: list[pa.RecordBatch] = []
        size, key = 0, None
        for batch in batches:
            m, part = batch.column("m").to_numpy(), batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(m) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(m)]
            windows = np.cumsum([0, *(n - length + 1 for n in pa.compute.utf8_length(batch.column("s")).to_pylist())])
            start = 0
            for a, b in zip(edges, edges[1:]):
                if (m[a], part[a]) != key:
                    if size + windows[a] - windows[start] + windows[b] - windows[a] > _WINDOWS and size + windows[a] > windows[start]:
                        yield from solved([*held, batch.slice(start, a - start)] if a > start else held)
                        held, size, start = [], 0, a
                    key = m[a], part[a]
            if len(m) > start:
                held.append(batch.slice(start))
                size += int(windows[-1] - windows[start])
        if held:
            yield from solved(held)

    return packed.repartition("m", "part").sortWithinPartitions("m", "part").select("m", "part", "parts", "id", "at", "s").mapInArrow(run, _FOUND)


def _across_parts(found: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Members (s0, s1, id) of classes, and spans (id, begin, end), of windows that several parts of a bucket have."""
    rows = found.where(F.col("kind") == _OPEN).select("k0", "k1", "s0", "s1", "n", "id", "begin", "end")
    whole = rows.groupBy("k0", "k1").agg(F.bit_xor("s0").alias("t0"), F.bit_xor("s1").alias("t1"), F.sum((F.col("n") > 0).cast("int")).alias("parts")).where("parts > 1")
    met = materialize(rows.join(whole.drop("parts"), ["k0", "k1"]), "windows")
    kept = met.groupBy("t0", "t1").agg(F.min(F.struct("k0", "k1")).alias("k")).select(F.col("t0").alias("c0"), F.col("t1").alias("c1"), F.col("k.k0").alias("k0"), F.col("k.k1").alias("k1"))
    parts = met.where("n > 0").join(kept, ["k0", "k1"]).select("c0", "c1", "s0", "s1", "n", "id")
    local = found.where(F.col("kind") == _MEMBER).select("s0", "s1", F.col("id").alias("member")).distinct()
    many = parts.where("n > 1").select("c0", "c1", "s0", "s1").distinct().join(local, ["s0", "s1"]).select("c0", "c1", "member")
    members = parts.where("n = 1").select("c0", "c1", F.col("id").alias("member")).union(many)
    return members.toDF("s0", "s1", "id"), met.where("begin >= 0").select("id", "begin", "end")


def shared_spans(df: DataFrame, id_column: str, text_column: str, length: int = LENGTH, minimiser: int = MINIMISER, part: int = PART) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes (s0, s1, id) of representatives with a window in common, spans (id, begin, end) of representatives that are
    shared, and members (rep, id) of classes of equal texts.
    """
    if not 0 < minimiser <= length:
        raise ValueError("a minimiser must fit into a window")
    texts, members = distinct_texts(df.select(F.lit(0).alias("t"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("x")))
    long = texts.where(F.length("x") >= length)
    counted = materialize(_minimisers(long, length, minimiser).groupBy("m").agg(F.count("*").alias("n")).where("n > 1"), "minimisers")
    words = df.sparkSession.sparkContext.broadcast(hash_filter(counted, "m", filter_bits(counted.count())))
    # A table of its own, so that its size is known when the join is planned.
    divided = materialize(counted.where(F.col("n") > part).select("m", F.ceil(F.col("n") / part).cast("int").alias("parts")), "divided")
    packed = _packed(long, words, length, minimiser).join(divided, "m", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    found = materialize(_bucketed(packed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), length), "shared")
    classes, spans = _across_parts(found, length)
    classes = found.where(F.col("kind") == _MEMBER).select("s0", "s1", "id").union(classes).distinct()
    spans = found.where(F.col("kind") == _SPAN).select("id", "begin", "end").union(spans)
    return classes, spans, members.select("rep", "id")


def expand(classes: DataFrame, members: DataFrame, texts: DataFrame, id_column: str, text_column: str, length: int = LENGTH) -> DataFrame:
    """(doc_a, doc_b): all pairs of documents that share a span, copies included."""
    pairs = class_pairs(classes, ["s0", "s1"]).select("a", "b").distinct()
    one, two = (members.select(F.col("rep").alias(rep), F.col("id").alias(i)) for rep, i in (("a", "i"), ("b", "j")))
    across = pairs.join(one, "a").join(two, "b").select(F.least("i", "j").alias("doc_a"), F.greatest("i", "j").alias("doc_b"))
    long = texts.where(F.length(F.col(f"`{text_column}`")) >= length).select(F.col(f"`{id_column}`").alias("rep"))
    within = class_pairs(members.join(long, "rep", "left_semi"), ["rep"])
    return across.union(within.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")))


def coverage(spans: DataFrame, members: DataFrame, texts: DataFrame, id_column: str, text_column: str, length: int = LENGTH) -> DataFrame:
    """(id, n_chars, shared_chars, spans) of every document with a text: how much of it is shared elsewhere; spans that touch are one."""
    spans = spans.withColumnRenamed("id", "a")
    order = Window.partitionBy("a").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    pieces = spans.withColumn("new", F.when(before >= F.col("begin"), 0).otherwise(1)).withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.coalesce(before, F.lit(0)))))
    per = pieces.groupBy("a").agg(F.sum("fresh").alias("shared"), F.sum("new").alias("spans")).withColumnRenamed("a", "rep")
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    every = members.join(sizes, "rep").join(per, "rep", "left")
    chars = texts.where(F.col(f"`{text_column}`").isNotNull()).select(F.col(f"`{id_column}`").alias("id"), F.length(F.col(f"`{text_column}`")).cast("bigint").alias("n_chars"))
    whole = (F.col("copies") > 1) & (F.col("n_chars") >= length)
    return chars.join(every, "id").select(
        F.col("id").alias(id_column), "n_chars", F.when(whole, F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0))).alias("shared_chars"), F.when(whole, F.lit(1).cast("bigint")).otherwise(F.coalesce("spans", F.lit(0))).alias("spans")
    )
