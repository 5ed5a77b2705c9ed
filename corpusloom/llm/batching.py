"""Arrow batch helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: A Python worker holds the tokens of about this many bytes of text at a time.
TEXT_BYTES = 1_500_000


def text_slices(batches: Iterable[pa.RecordBatch], column: str, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes in ``column`` (or one row), so that memory doesn't follow row counts."""
    for batch in batches:
        sizes = [0 if n is None else n for n in pa.compute.binary_length(batch.column(column)).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
