"""Cutting oversized items at natural boundaries, with overlap (problem 4).

Every place between two code tokens has a boundary strength: the end of a top-level block, a blank line, the
end of a statement, a line end, a sentence end in a comment, and so on. The strongest cut in the permissible
window of each piece comes from a sparse table of range maxima: one row per power of two, one query per piece. A
piece ends at the strongest boundary; of equal ones that counts where the next piece, stepping back by the
overlap, begins at the stronger boundary; what is still equal is broken rightward. Pieces are ranges of the
text as it is, so their new parts joined are the text again.

Defined results: null, empty and short texts give no row; a window without any boundary is cut at its right
end between two tokens; white space between tokens belongs to the piece before the cut; equal rows are cut alike;
repeated ids give repeated pieces; stored lengths aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import CODE_TOKEN
from .batching import text_slices

LIMIT = 1024
OVERLAP = 64

#: Code points after which a cut is better than elsewhere in a line.
_STATEMENT = np.array([ord(c) for c in ";{}"], np.uint32)
_CLAUSE = np.array([ord(c) for c in ".。!?！？,，:：；"], np.uint32)


class RangeMax:
    """Sparse table: the place of the greatest value in any range, the rightmost of equal ones."""

    def __init__(self, values: np.ndarray, widest: int):
        n = len(values)
        self.scale = n + 1
        row = values.astype(np.int64) * self.scale + np.arange(n)
        self.rows = [row]
        step = 1
        while 2 * step <= min(widest, n):
            row = np.maximum(row[:-step], row[step:])
            self.rows.append(row)
            step *= 2

    def argmax(self, first: int, last: int) -> int:
        """Place of the maximum in first..last, both included."""
        level = (last - first + 1).bit_length() - 1
        row = self.rows[level]
        return int(max(row[first], row[last + 1 - (1 << level)])) % self.scale


def strengths(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Strength of the boundary before each token, and after the last: n + 1 values from 0 to 6."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    feeds = (points == 10) | ((points == 13) & (np.append(points[1:], 0) != 10))
    lines = np.concatenate([[0], np.cumsum(feeds)])
    out = np.full(len(starts) + 1, 6, np.int64)
    before, after = ends[:-1], starts[1:]
    broken = lines[after] - lines[before]
    previous = points[before - 1]
    column_0 = (points[after - 1] == 10) | (points[after - 1] == 13)
    statement, clause, spaced = np.isin(previous, _STATEMENT), np.isin(previous, _CLAUSE), after > before
    s = np.zeros(len(after), np.int64)
    s[spaced & clause] = 1
    s[statement] = 1
    s[broken > 0] = 2
    s[(broken > 0) & (statement | clause)] = 3
    s[broken > 1] = 4
    s[(broken > 0) & column_0 & (previous == ord("}"))] = 5
    s[(broken > 1) & column_0] = 6
    out[1:-1] = s
    return out


def cuts(strength: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Token ranges of the pieces of a text of ``len(strength) - 1`` tokens."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    n = len(strength) - 1
    if n <= limit:
        return [(0, n)]
    begins = np.concatenate([np.zeros(overlap, np.int64), strength[: n + 1 - overlap]])
    table = RangeMax(strength * 8 + begins, limit)
    pieces, start, shortest = [], 0, limit // 2
    while n - start > limit:
        end = table.argmax(start + shortest, start + limit)
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, n))
    return pieces


def split_texts(df: DataFrame, id_column: str, text_column: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(id, piece, token_start, token_end, char_start, char_end, repeated[, text]) of each text of more than ``limit`` tokens.

    ``repeated`` is the number of leading tokens that the piece before ends with. Narrow: no shuffle.
    """
    columns = "piece int, token_start int, token_end int, char_start int, char_end int, repeated int" + ", text string" * with_text
    kind = df.schema[id_column].dataType.simpleString()
    types = [pa.int32()] * 6 + [pa.string()] * with_text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "x"):
            rows: list[list] = [[] for _ in range(7)]
            take: list[int] = []
            for i, text in enumerate(part.column("x").to_pylist()):
                spans = [m.span() for m in CODE_TOKEN.finditer(text)]
                if len(spans) <= limit:
                    continue
                at = np.array(spans, np.int64)
                pieces = cuts(strengths(text, at[:, 0], at[:, 1]), limit, overlap)
                for k, (a, b) in enumerate(pieces):
                    char = (spans[a][0] if k else 0, spans[b][0] if b < len(spans) else len(text))
                    take.append(i)
                    for column, value in zip(rows, (k, a, b, *char, overlap if k else 0, text[slice(*char)])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([part.column("i").take(pa.array(take, pa.int64())), *(pa.array(r, t) for r, t in zip(rows, types))], names=["i", *(c.split()[0] for c in columns.split(", "))])

    # A text of no more characters than the limit can't have more tokens.
    rows = df.select(F.col(f"`{id_column}`").alias("i"), F.col(f"`{text_column}`").alias("x")).where(F.length("x") > limit)
    return rows.mapInArrow(run, f"i {kind}, {columns}").withColumnRenamed("i", id_column)
