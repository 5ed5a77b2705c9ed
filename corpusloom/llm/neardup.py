"""Near-duplicate records by multi-index hashing (problem 1).

Fingerprint. Of each text the distinct five-token shingles give ``SEGMENTS`` x ``SYMBOLS`` minima under independent
permutations; ten bits of each are a symbol. Two texts of similarity s agree in a symbol with a chance of about s,
so the Hamming distance of two fingerprints (symbols that differ) estimates 1 - s.

Index. A segment of six symbols is one table. Around each fingerprint's segment the Hamming ball of radius 1 is
enumerated as six keys, in each of which one symbol is left free; two segments lie in each other's ball, up to one
differing symbol, if they share a key. Table matches are fetched by an equi-join on the key, complete distances
are checked on whole fingerprints, and an exact comparison of shingle sets follows. A pair of similarity
0.8 is missed by all eight tables with a chance of 2e-4, one of 0.85 with 4e-6; above, far less. Five symbols of 50 bits
keep boilerplate that most files share from making candidates: similarity 0.05 gives a key in common in 1 of 70,000 pairs.

Copies. Texts with the same tokens are one class, found by a digest with partial aggregation; only one
representative of each class takes part in the index, so a group of copies with a third of all rows costs as much
as one row. ``pairs`` are between representatives; ``expand`` gives pairs of records.

Versions. Many versions of one template share keys without being copies. Keys are counted first, with partial aggregation, and only
those of several representatives go on. The representatives of a key are dealt to blocks of about ``BLOCK``; each two blocks meet in a
group of their own, so no task gets more than two, however many share the key. There all distances are computed at once, and a
pair is passed on only by the first of the keys it shares, so it is compared once. For the comparison the shingles of each text are hashed
once and go once to each group (of ``COMPARED`` per side) in which it has a pair, not once per pair.

Defined results: null, empty and short texts (under five tokens) are in no pair; repeated rows are copies
of each other; texts that differ in white space only are copies; ids must be unique within a table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import SHINGLE, code_token_hashes, shingle_set, window_hashes
from ..session import materialize
from .batching import text_slices
from .copies import class_pairs

THRESHOLD = 0.8
SEGMENTS = 8
SYMBOLS = 6
BITS = 10
#: Complete distance above which a candidate isn't compared: at similarity 0.8 it is 9.6 of 48 on average, with a deviation of 2.8.
FARTHEST = 22
#: Representatives in a block of a key, about, while fingerprints meet, and while texts do; rows of fingerprints handled at a time.
BLOCK, COMPARED, _ROWS = 2_000, 512, 20_000

_ODD = np.random.default_rng(20240229).integers(1, 2**63, SEGMENTS * SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SYMBOL = np.uint64((1 << BITS) - 1)


def fingerprints(shingles: list[np.ndarray]) -> np.ndarray:
    """One row of SEGMENTS 60-bit segments for each non-empty array of shingle hashes."""
    starts = np.cumsum([0, *map(len, shingles)])[:-1]
    every = np.concatenate(shingles)
    out = np.zeros((len(shingles), SEGMENTS), np.uint64)
    for k, odd in enumerate(_ODD):
        least = np.minimum.reduceat(every * odd, starts)
        # The low bits of a minimum are as good as random: its rank shows in the high bits only.
        out[:, k // SYMBOLS] |= ((least ^ (least >> np.uint64(17))) & _SYMBOL) << np.uint64(BITS * (k % SYMBOLS))
    return out.view(np.int64)


def signatures(texts: DataFrame) -> DataFrame:
    """(t, id, d0, d1, s0...): token digest and segments of each text with a shingle; from (t, id, x)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "x"):
            shingles, digests, rows = [], [], []
            for i, text in enumerate(part.column("x").to_pylist()):
                tokens = code_token_hashes(text)
                if len(tokens) >= SHINGLE:
                    shingles.append(window_hashes(tokens))
                    digests.append(_digest(tokens))
                    rows.append(i)
            if rows:
                kept = part.take(pa.array(rows, pa.int64()))
                segments, digest = fingerprints(shingles), np.array(digests, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [kept.column("t"), kept.column("id"), *(pa.array(digest[:, j]) for j in range(2)), *(pa.array(segments[:, j]) for j in range(SEGMENTS))],
                    names=["t", "id", "d0", "d1", *(f"s{j}" for j in range(SEGMENTS))],
                )

    return texts.select("t", "id", "x").where("x is not null and id is not null").mapInArrow(run, "t int, id bigint, d0 bigint, d1 bigint, " + ", ".join(f"s{j} bigint" for j in range(SEGMENTS)))


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    import xxhash

    value = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return value >> 64, value & (1 << 64) - 1


def _meetings(symbols: np.ndarray, group: np.ndarray, place: np.ndarray, own: np.ndarray, mixed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of the pairs within groups whose first shared key is that of the group, with a small complete distance.

    ``place`` is the key's place among all keys of a fingerprint; in a ``mixed`` group only rows of different blocks (``own``) are paired.
    """
    live = np.arange(len(group))
    for d in range(1, len(group)):
        live = live[live + d < len(group)]
        live = live[group[live + d] == group[live]]
        if not len(live):
            return
        for k in range(0, len(live), _ROWS):
            i = live[k : k + _ROWS]
            i = i[~mixed[i] | (own[i] != own[i + d])]
            same = (symbols[i] == symbols[i + d]).reshape(-1, SEGMENTS, SYMBOLS)
            agree = same.sum(2)
            ball = agree >= SYMBOLS - 1
            segment = ball.argmax(1)
            at = np.arange(len(i))
            # All six agree: the segment's first key is shared; five: only the key in which the sixth is free.
            first = segment * SYMBOLS + np.where(agree[at, segment] == SYMBOLS, 0, same[at, segment].argmin(1))
            good = ball[at, segment] & (first == place[i]) & (SEGMENTS * SYMBOLS - agree.sum(1) <= FARTHEST)
            yield i[good], i[good] + d


def candidates(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(t, a, b, key, n) pairs of representatives, a < b, that share a ball key and whose complete distance is small, each once, with the
    first key they share and the number of representatives that have it; from (t, rep, s0...)."""
    balls = []
    for j in range(SEGMENTS):
        for i in range(SYMBOLS):
            free = ~(((1 << BITS) - 1) << (BITS * i))
            balls.append(F.xxhash64("t", F.lit(j * SYMBOLS + i), F.col(f"s{j}").bitwiseAND(F.lit(free))))
    keys = classes.select("t", "rep", F.posexplode(F.array(*balls)).alias("place", "key"))
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    met = keys.join(shared, "key").select("key", F.col("place").cast("tinyint").alias("place"), "t", "rep", "n")
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = met.join(classes.select("t", "rep", *[f"s{j}" for j in range(SEGMENTS)]), ["t", "rep"]).withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            column = {c: table.column(c).to_numpy() for c in table.column_names}
            segments = np.stack([column[f"s{j}"].view(np.uint64) for j in range(SEGMENTS)], axis=1)
            shifts = np.arange(SYMBOLS, dtype=np.uint64) * np.uint64(BITS)
            symbols = ((segments[:, :, None] >> shifts) & _SYMBOL).astype(np.uint16).reshape(len(segments), -1)
            key, lo, hi = column["key"], column["lo"], column["hi"]
            group = np.cumsum(np.concatenate([[0], (np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)]))
            for i, j in _meetings(symbols, group, column["place"], column["own"], lo != hi):
                x, y = column["rep"][i], column["rep"][j]
                # A key is a hash; the tables of two texts that meet by chance may differ.
                on = column["t"][i] == column["t"][j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[on]) for c in (column["t"][i], np.minimum(x, y), np.maximum(x, y), key[i], column["n"][i])], names=["t", "a", "b", "key", "n"]
                )

        held: list[pa.RecordBatch] = []
        size = 0
        for part in batches:
            same = np.ones(max(0, len(part) - 1), bool)
            for c in ("key", "lo", "hi"):
                same &= np.diff(part.column(c).to_numpy()) == 0
            edge = np.flatnonzero(~same)
            if held and size > _ROWS and any(part.column(c)[0] != held[-1].column(c)[-1] for c in ("key", "lo", "hi")):
                yield from solved(held)
                held, size = [], 0
            if len(edge) and size + len(part) > _ROWS:
                cut = int(edge[-1]) + 1
                yield from solved([*held, part.slice(0, cut)])
                held, size, part = [], 0, part.slice(cut)
            held.append(part)
            size += len(part)
        if held:
            yield from solved(held)

    group = ["key", "lo", "hi"]
    return rows.repartition(*group).sortWithinPartitions(*group).select("key", "lo", "hi", "place", "own", "t", "rep", "n", *[f"s{j}" for j in range(SEGMENTS)]).mapInArrow(run, "t int, a bigint, b bigint, key bigint, n bigint")


def _shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values two sets (sorted, distinct) have in common, for each pair of numbers in ``left`` (ascending) and ``right``."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    begin = np.cumsum(sizes) - sizes
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    on = np.zeros(len(values), np.int64)
    out = np.zeros(len(left), np.int64)
    edges = [0, *(np.flatnonzero(np.diff(left)) + 1).tolist(), len(left)]
    for a, b in zip(edges, edges[1:]):
        mine = number[begin[left[a]] : begin[left[a]] + sizes[left[a]]]
        on[mine] = 1
        for k in range(a, b, 512):
            some = right[k : min(b, k + 512)]
            ends = np.cumsum(sizes[some])
            at = np.arange(int(ends[-1])) - np.repeat(ends - sizes[some], sizes[some]) + np.repeat(begin[some], sizes[some])
            out[k : k + len(some)] = np.add.reduceat(on[number[at]], ends - sizes[some])
        on[mine] = 0
    return out


def compared(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, block: int = COMPARED) -> DataFrame:
    """(t, a, b, shared, all): the pairs whose similarity is at least ``threshold``, exactly; from ``candidates`` and (t, id, x)."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = pairs.select("t", "a", "b", "key", F.pmod(F.xxhash64("a"), blocks).cast("int").alias("lo"), F.pmod(F.xxhash64("b"), blocks).cast("int").alias("hi"))
    group = ["t", "key", "lo", "hi"]
    needed = materialize(dealt.select(*group, F.explode(F.array("a", "b")).alias("id")).distinct(), "needed")
    sets = materialize(_shingled(texts.join(needed.select("t", "id").distinct(), ["t", "id"], "left_semi")), "shingles")
    sent = sets.join(needed, ["t", "id"]).select(*group, F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), "h")
    both = sent.unionByName(dealt.withColumn("h", F.lit(None).cast("binary")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple = ()
        ids: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def solved() -> Iterator[pa.RecordBatch]:
            if not pairs:
                return
            known = np.concatenate(ids)
            order = np.argsort(known)
            a, b = (np.concatenate(c) for c in zip(*pairs))
            i, j = (order[np.searchsorted(known, side, sorter=order)] for side in (a, b))
            by = np.argsort(i, kind="stable")
            a, b, i, j = a[by], b[by], i[by], j[by]
            common = _shared_counts(sets, i, j)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            every = sizes[i] + sizes[j] - common
            good = common >= threshold * every - 1e-9
            columns = (np.full(int(good.sum()), key[0]), a[good], b[good], common[good], every[good])
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["t", "a", "b", "shared", "all"])

        for part in text_slices(batches, "h"):
            columns = [part.column(c).to_numpy() for c in group]
            edges = [0, *(np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1).tolist(), len(part)]
            for start, end in zip(edges, edges[1:]):
                own = tuple(int(c[start]) for c in columns)
                if own != key:
                    yield from solved()
                    key, ids, sets, pairs = own, [], [], []
                rows = part.slice(start, end - start)
                # The shingles of a group come before its pairs.
                n = rows.column("b").null_count
                if n:
                    ids.append(rows.column("a").slice(0, n).to_numpy())
                    sets += [np.frombuffer(h, np.uint64) for h in rows.column("h").slice(0, n).to_pylist()]
                if n < len(rows):
                    pairs.append((rows.column("a").slice(n).to_numpy(), rows.column("b").slice(n).to_numpy()))
        yield from solved()

    return both.repartition(*group).sortWithinPartitions(*group, F.col("b").asc_nulls_first()).mapInArrow(run, "t int, a bigint, b bigint, shared int, all int")


def _shingled(texts: DataFrame) -> DataFrame:
    """(t, id, h): the sorted distinct shingle hashes of each text as bytes; from (t, id, x)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "x"):
            hashes = pa.array([shingle_set(x).tobytes() for x in part.column("x").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("t"), part.column("id"), hashes], names=["t", "id", "h"])

    return texts.select("t", "id", "x").mapInArrow(run, "t int, id bigint, h binary")


def near_duplicates(texts: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Pairs (t, a, b, shared, all) of class representatives, and members (t, rep, id) of all classes; from (t int, id bigint, x string)."""
    if threshold < THRESHOLD:
        raise ValueError("the tables are laid out for similarities of 0.8 and more")
    texts = texts.select("t", "id", "x")
    signed = materialize(signatures(texts), "signatures")
    classes = signed.groupBy("t", "d0", "d1").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *[F.first(f"s{j}").alias(f"s{j}") for j in range(SEGMENTS)])
    classes = materialize(classes, "classes")
    pairs = compared(materialize(candidates(classes), "candidates"), texts, threshold)
    members = signed.select("t", "id", "d0", "d1").join(classes.select("t", "d0", "d1", "rep"), ["t", "d0", "d1"]).select("t", "rep", "id")
    return pairs, members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(t, id_a, id_b) of all pairs of records: across similar classes and within each class."""
    one, two = (members.select(F.col("t"), F.col("rep").alias(rep), F.col("id").alias(i)) for rep, i in (("a", "i"), ("b", "j")))
    across = pairs.select("t", "a", "b").join(one, ["t", "a"]).join(two, ["t", "b"]).select("t", F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))
    return across.union(class_pairs(members, ["t", "rep"]).select("t", F.col("a").alias("id_a"), F.col("b").alias("id_b")))


def groups(pairs: DataFrame, members: DataFrame, rounds: int = 64) -> DataFrame:
    """(t, id, group, links): the connected group of each record, named by its least representative, and the number of
    representatives that the record's class is linked to. Every record with a shingle has a row.

    Labels travel by minima over links and are then followed to their own labels, so rounds grow with the logarithm of a
    component's length in practice; each round writes a table to the shared folder.
    """
    links = materialize(pairs.select("t", F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("t", F.col("b").alias("u"), F.col("a").alias("v"))), "links")
    labels = links.groupBy("t", "u").agg(F.least(F.col("u"), F.min("v")).alias("label"), F.count("*").alias("links"))
    labels = materialize(labels, "labels")
    for _ in range(rounds):
        near = links.join(labels.select("t", F.col("u").alias("v"), "label"), ["t", "v"]).groupBy("t", "u").agg(F.min("label").alias("near"))
        stepped = labels.join(near, ["t", "u"]).select("t", "u", F.least("label", "near").alias("step"), "links", F.col("label").alias("old"))
        jump = labels.select("t", F.col("u").alias("step"), F.col("label").alias("far"))
        moved = materialize(stepped.join(jump, ["t", "step"], "left").select("t", "u", F.least("step", F.coalesce("far", "step")).alias("label"), "links", "old"), "labels")
        labels = moved.drop("old")
        if moved.where("label <> old").isEmpty():
            break
    else:
        raise RuntimeError(f"groups were not settled after {rounds} rounds")
    return members.join(labels.withColumnRenamed("u", "rep"), ["t", "rep"], "left").select("t", "id", F.coalesce("label", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
