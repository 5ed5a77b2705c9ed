"""Batch-wise code tokens and shingle hashes for Arrow operators.

Tokens are identifiers, digit runs and other single non-space characters (Unicode). Hashing one
distinct token costs one dictionary miss; everything after that is NumPy over whole batches.
"""

from __future__ import annotations

import re
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the token pattern.
CODE_TOKEN = re.compile(r"[A-Za-z_]\w*|\d+|[^\s]")
SHINGLE = 5
_MAX_CACHED = 1_000_000
_STEP = np.uint64(29)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class HashCache(dict):
    """String to 64-bit hash; emptied when it has grown past its bound, which never changes a value."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _MAX_CACHED:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return value


_cache = HashCache()


def hashed(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_cache.__getitem__, tokens), np.uint64, len(tokens))


def code_token_hashes(text: str | None) -> np.ndarray:
    """One hash per code token of ``text``; none for null."""
    return hashed(CODE_TOKEN.findall(text)) if text else np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(tokens: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hash of every run of ``width`` consecutive token hashes (empty if there are fewer)."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = tokens[:n] * _MULTIPLIERS[0]
    for j in range(1, width):
        h = (h ^ (h >> _STEP)) * _MULTIPLIERS[j % 5] + tokens[j : j + n]
    return mix(h)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-token shingles of ``text``."""
    return np.unique(window_hashes(code_token_hashes(text)))


def shingle_hash_set(tokens: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes as signed numbers; of single tokens where there are fewer than five."""
    return np.unique((window_hashes(tokens) if len(tokens) >= SHINGLE else mix(tokens)).view(np.int64))


@F.arrow_udf(T.StructType([T.StructField("tokens", T.IntegerType()), T.StructField("shingles", T.ArrayType(T.LongType()))]))
def token_shingles(text: pa.Array) -> pa.Array:
    """Number of code tokens and distinct shingle hashes (of single tokens where there are fewer than five); null for null.

    Array functions on token strings would make a string per shingle.
    """
    counts, sets, known = [], [], []
    for x in text.to_pylist():
        known.append(x is None)
        tokens = code_token_hashes(x)
        counts.append(len(tokens))
        sets.append(shingle_hash_set(tokens))
    ends = np.cumsum([0, *map(len, sets)])
    values = np.concatenate(sets) if sets else np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), lists], names=["tokens", "shingles"], mask=pa.array(known, pa.bool_()))
