"""Held-out records found again in the train split (problem 3): an edit-distance segment join.

A held-out record counts as found in a train record if at least ``CONTAINED`` of its d distinct shingles are there.
So k = floor((1 - CONTAINED) d) shingles may be missing, and of any k + c distinct shingles of it at least c are in the
train record, in whatever order and place. These single shingles are its segments; longer ones would break without a shingle
missing where shared shingles aren't consecutive in the train record. A record offers an eighth more of its shingles than
the k + 1 it must: those that are rarest in a sample of the train split, which orders them and decides nothing. Train
records' shingles are matched to them by hash: a filter of bounded size first, then an equi-join. The k + c that are rarest in
the whole train split are enough, which leaves out boilerplate, and a train record is a candidate if it has c of them; c takes
up a quarter of those beyond k + 1. A match is allowed at any position of a train record that is long enough: the measure
knows no order, so blocks may have moved.

Candidates are verified by banded dynamic programming along the diagonal of the match, many pairs to one NumPy array: it gives the
token edits to the best substring there. An edit touches at most five shingles, so up to k / 5 edits prove that no more than k are
missing; the band is that wide and such a pair is settled. The distance can't settle the others, as blocks may have moved and edits
may lie close together: of these, and of pairs whose table would have more than ``CELLS`` cells, the exact count of shared shingles
decides. ``edits`` is null where the alignment leaves the band or isn't tried, ``shared`` where edits settled the pair. ``edits`` is 0
wherever in the train record the whole held-out record stands; above 0 it holds for that one diagonal.

Defined results: null, empty and short texts (under five tokens) are in no pair; records without a split are left out; repeated
rows count each; equal texts are compared once per side and expanded at the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import SHINGLE, code_token_hashes, shingle_set, window_hashes
from ..session import materialize
from .batching import text_slices
from .copies import distinct_texts, filter_bits, hash_filter, passes, slices_of

CONTAINED = 0.85
#: Train texts from which common shingles are known, about, and how many of these are sent to the workers at most (16 bytes each).
SAMPLE, MOST_COMMON = 2_000, 1_000_000
#: A pair's table has at most so many cells; pairs filled at once have so many tokens.
CELLS, _TOKENS = 4_000_000, 300_000


def allowed_missing(distinct: int, contained: float = CONTAINED) -> int:
    return int((1 - contained) * distinct + 1e-9)


def segments(tokens: np.ndarray, contained: float = CONTAINED, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[int, int, np.ndarray]:
    """(length in shingles, distinct shingles, first place of each segment) of a record's token hashes.

    ``common`` has sorted shingle hashes and how often each is met; the rarest come first, then the smallest hashes.
    """
    shingles, first = np.unique(window_hashes(tokens), return_index=True)
    distinct = len(shingles)
    least = allowed_missing(distinct, contained) + 1
    often = np.zeros(distinct, np.int64)
    if common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], shingles), len(common[0]) - 1)
        often = np.where(common[0][at] == shingles, common[1][at], 0)
    return 1, distinct, first[np.argsort(often, kind="stable")[: least + (distinct - least) // 8]]


def banded_edits(left: list[np.ndarray], right: list[np.ndarray], shift: list[int], band: list[int]) -> list[int | None]:
    """For each pair the least edits from ``left`` to a substring of ``right``, over alignments within ``band`` of the diagonal ``shift``.

    None if it is more than the band.
    """
    pairs = len(left)
    k = max(band)
    width = 2 * k + 1
    n = np.fromiter(map(len, left), np.int64, pairs)
    rows = int(n.max())
    a = np.zeros((pairs, rows), np.uint64)
    b = np.zeros((pairs, rows + width), np.uint64)
    real = np.zeros((pairs, rows + width), bool)
    for p in range(pairs):
        a[p, : n[p]] = left[p]
        first = shift[p] - k  # the token of right in column 0 of the window
        lo, hi = max(0, first), min(len(right[p]), first + rows + width)
        if hi > lo:
            b[p, lo - first : hi - first] = right[p][lo:hi]
            real[p, lo - first : hi - first] = True
    far = rows + width
    step = np.arange(width)
    inside = np.abs(step[None, :] - k) <= np.array(band)[:, None]
    row = np.where(inside, 0, far)
    out = np.full(pairs, far)
    for i in range(rows):
        same = (b[:, i : i + width] == a[:, i : i + 1]) & real[:, i : i + width]
        new = row + ~same
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new = np.where(inside, new, far)
        row = np.minimum(np.minimum.accumulate(new - step, axis=1) + step, far)
        row[~inside] = far
        ended = n == i + 1
        if ended.any():
            out[ended] = row[ended].min(1)
        if i % 32 == 31 and (row.min(1) > k).all():
            break  # no alignment is left in the band, and distances only grow
    return [int(e) if e <= w else None for e, w in zip(out, band)]


def within(tokens: np.ndarray, other: np.ndarray) -> bool:
    """Whether ``tokens`` are consecutive in ``other``."""
    wanted, text = tokens.tobytes(), other.tobytes()
    at = text.find(wanted)
    while at % tokens.itemsize and at >= 0:
        at = text.find(wanted, at + 1)
    return at >= 0


def _common(train: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met more than once in a sample of the train texts, sorted, and how often."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "x"):
            found = np.concatenate([np.empty(0, np.uint64), *map(shingle_set, part.column("x").to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    sample = train.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(min(1.0, SAMPLE / max(1, count)) * (1 << 30)))
    counts = sample.select("x").mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    table = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    hashes = table.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], table.column("n").to_numpy()[order]


def _cut(texts: DataFrame, contained: float, common) -> DataFrame:
    """(id, p, h): the segments of held-out texts; p packs the place of the shingle and d in one number, as rows are shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "x"):
            columns: list[list] = [[] for _ in range(3)]
            for i, text in zip(part.column("id").to_pylist(), part.column("x").to_pylist()):
                tokens = code_token_hashes(text)
                if len(tokens) < SHINGLE:
                    continue
                _, distinct, at = segments(tokens, contained, common.value)
                hashes = window_hashes(tokens)[at]
                for column, values in zip(columns, (np.full(len(at), i), at << 32 | distinct, hashes.view(np.int64))):
                    column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], names=["id", "p", "h"])

    return texts.select("id", "x").mapInArrow(run, "id bigint, p bigint, h bigint")


def _matched(texts: DataFrame, words) -> DataFrame:
    """(id, p, h): shingles of train texts that pass the filter, each once per text; p packs its first position and the text's shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = words.value
        for part in text_slices(batches, "x"):
            columns: list[list] = [[] for _ in range(3)]
            for i, text in zip(part.column("id").to_pylist(), part.column("x").to_pylist()):
                hashes = window_hashes(code_token_hashes(text))
                at = np.flatnonzero(passes(bits, hashes))
                if len(at):
                    found, first = np.unique(hashes[at], return_index=True)
                    for column, values in zip(columns, (np.full(len(found), i), at[first] << 32 | len(hashes), found.view(np.int64))):
                        column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], names=["id", "p", "h"])

    return texts.select("id", "x").mapInArrow(run, "id bigint, p bigint, h bigint")


def _verified(pairs: DataFrame, texts: DataFrame, contained: float) -> DataFrame:
    """(a, b, shared, d, edits) of the pairs (a, b, shift) that hold."""
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = materialize(texts.select("id", "x").join(needed, "id", "left_semi"), "overlap-texts")
    both = pairs.join(wanted.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b").join(wanted.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None,)
        for part in slices_of(batches, ["xa", "xb"]):
            pairs: list[tuple] = []
            for a, b, shift, xa, xb in zip(*(part.column(c).to_pylist() for c in ("a", "b", "shift", "xa", "xb"))):
                if last[0] != a:
                    last = a, code_token_hashes(xa), shingle_set(xa)
                _, tokens, mine = last
                pairs.append((tokens, code_token_hashes(xb), shift, allowed_missing(len(mine), contained) // SHINGLE, mine, a, b))
            good = []
            for pair, edits in zip(pairs, aligned(pairs)):
                tokens, other, _, _, mine, a, b = pair
                shared = None
                if edits is None:
                    shared = len(np.intersect1d(mine, np.unique(window_hashes(other)), assume_unique=True))
                    if shared < contained * len(mine) - 1e-9:
                        continue
                good.append((a, b, shared, len(mine), 0 if edits != 0 and within(tokens, other) else edits))
            yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in good], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["a", "b", "shared", "d", "edits"])

    return both.select("a", "b", "shift", "xa", "xb").mapInArrow(run, "a bigint, b bigint, shared int, d int, edits int")


def aligned(pairs: list[tuple]) -> list[int | None]:
    """Edits of each (tokens, other, shift, band, ...) within its band, in arrays of bounded size; None for tables beyond ``CELLS``."""
    out: list[int | None] = [None] * len(pairs)
    fit = sorted((k for k, p in enumerate(pairs) if len(p[0]) * (2 * p[3] + 1) <= CELLS), key=lambda k: len(pairs[k][0]))
    while fit:
        # The longest is last, so what comes before it isn't larger.
        longest = pairs[fit[-1]]
        some = fit[-max(1, _TOKENS // (2 * len(longest[0]) + 4 * longest[3] + 1)) :]
        del fit[-len(some) :]
        for k, edits in zip(some, banded_edits(*(list(c) for c in zip(*(pairs[k][:4] for k in some))))):
            out[k] = edits
    return out


def split_overlaps(records: DataFrame, contained: float = CONTAINED) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, shared, d, edits) of a held-out and a train representative, and members (t, rep, id); from (t, id, x), t = 1 for held out, 0 for train.

    Ids must be unique over both sides.
    """
    texts, members = distinct_texts(records.select("t", "id", "x").where("t is not null"))
    held, train = texts.where("t = 1"), texts.where("t = 0")
    common = records.sparkSession.sparkContext.broadcast(_common(train, members.where("t = 0").count()))
    cut = materialize(_cut(held, contained, common), "segments")
    words = records.sparkSession.sparkContext.broadcast(hash_filter(cut, "h", filter_bits(cut.count())))
    hits = materialize(_matched(train, words), "matches")
    frequency = hits.groupBy("h").agg(F.count("*").alias("df"))
    by_record = Window.partitionBy("id")
    ranked = cut.select("id", "p", "h").join(frequency, "h", "left").select("id", "p", "h", F.coalesce("df", F.lit(0)).alias("df"))
    placed = ranked.withColumn("place", F.row_number().over(by_record.orderBy("df", "p"))).withColumn("count", F.count("*").over(by_record))
    d, low = F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0xFFFFFFFF)
    missing = F.floor(d * F.lit(1 - contained) + F.lit(1e-9))
    chosen = placed.withColumn("missing", missing).withColumn("least", 1 + F.floor((F.col("count") - F.col("missing") - 1) / 4)).where(F.col("place") <= F.col("missing") + F.col("least")).where("df > 0")
    # One number for both: how many matches a candidate needs, and how long it must be.
    chosen = chosen.select(F.col("id").alias("a"), "p", "h", "df", F.shiftleft("least", 32).bitwiseOR(F.ceil(d * F.lit(contained) - F.lit(1e-9))).alias("need"))
    met = chosen.join(hits.select(F.col("id").alias("b"), F.col("p").alias("q"), "h"), "h").where(F.col("q").bitwiseAND(low) >= F.col("need").bitwiseAND(low))
    shift = (F.shiftright("q", 32) - F.shiftright("p", 32)).cast("int")
    pairs = met.select("a", "b", "need", F.struct("df", "p", shift.alias("shift")).alias("m")).groupBy("a", "b", "need").agg(F.min("m").alias("m"), F.count("*").alias("c"))
    pairs = pairs.where(F.col("c") >= F.shiftright("need", 32)).select("a", "b", "m.shift")
    return _verified(materialize(pairs, "overlap-candidates"), texts, contained), members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(held, train, shared, d, edits): pairs of records."""
    held = members.where("t = 1").select(F.col("rep").alias("a"), F.col("id").alias("held"))
    train = members.where("t = 0").select(F.col("rep").alias("b"), F.col("id").alias("train"))
    return pairs.join(held, "a").join(train, "b").select("held", "train", "shared", "d", "edits")
