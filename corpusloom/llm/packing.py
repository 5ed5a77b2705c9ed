"""Filling containers of fixed capacity (problem 7).

Items longer than the capacity are cut into consecutive pieces: full ones, which are containers of their own,
and a rest. All other items and the rests are dealt by a hash of their id to groups of about ``group_items``; a
group is packed by the online sum-of-squares rule: of all fill levels that the item fits, and of a new container,
it takes that after which the sum of the squared numbers of containers by level is least. A level array holds those
numbers, and the level's open containers. Items arrive in hash order, but for the shortest quarter, which is held back and
arrives last, longest first, to fill what is left open. A group's size has a bound that doesn't depend on the corpus, groups are packed side by side, and each
leaves at most a few containers partly filled.

Defined results: items without tokens (null or empty text) are in no container; equal rows with one id are items of their own
only if their ids differ; an item that just fits the capacity fills a container; an empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import mix
from ..session import materialize
from .bpe import token_counts

CAPACITY = 4096
GROUP_ITEMS = 50_000
#: Share of the items of a group, the shortest, that arrive last.
LATE = 0.25


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, in the order given; sizes from 1 to ``capacity``."""
    levels = np.zeros(capacity + 1, np.int64)
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    made = 0
    for i, size in enumerate(sizes.tolist()):
        # The change of the sum of squares, halved: n(to) - n(from) + 1 between two levels; full containers aren't counted.
        change = levels[size:] - levels[: capacity + 1 - size] + 1
        change[0] = levels[size] if size < capacity else 0
        if size < capacity:
            change[-1] = -levels[capacity - size]
        change = 2 * change
        change[0] += 1
        if size < capacity:
            change[-1] += 1
        usable = levels[: capacity + 1 - size] > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        start = len(change) - 1 - int(np.argmin(change[::-1]))  # of equal levels the fullest
        if start:
            container = opened[start].pop()
            levels[start] -= 1
        else:
            container = made
            made += 1
        if (end := start + size) < capacity:
            opened[end].append(container)
            levels[end] += 1
        out[i] = container
    return out


def pack(df: DataFrame, id_column: str, size_column: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(id, piece, token_start, n_tokens, container): every piece of every item with a size of at least 1.

    ``id`` must be a bigint, unique. Containers have names, the same in every run.
    """
    items = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{size_column}`").cast("bigint").alias("size")).where("size > 0 and id is not null")
    items = materialize(items, "sizes")
    groups = max(1, -(-items.count() // group_items))
    full = F.floor(F.col("size") / capacity)
    items = items.withColumn("full", full).withColumn("rest", F.col("size") - F.col("full") * capacity).withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)))
    whole = items.where("full > 0").select("id", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"))
    rest = items.where("rest > 0").select("id", F.col("full").cast("int").alias("piece"), (F.col("full") * capacity).alias("token_start"), F.col("rest").alias("n_tokens"), "g")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", "id"], ascending=[False, True], kind="stable", ignore_index=True)
        early = int(len(part) * (1 - LATE))
        shuffled = np.argsort(mix(part["id"].to_numpy()[:early].astype(np.int64).view(np.uint64)), kind="stable")
        part = part.iloc[np.concatenate([shuffled, np.arange(early, len(part))])].reset_index(drop=True)
        group = int(part["g"].iloc[0])
        part["bin"] = sum_of_squares(part["n_tokens"].to_numpy(), capacity)
        return part.assign(container=f"g{group}-" + part["bin"].astype(str))[["id", "piece", "token_start", "n_tokens", "container"]]

    packed = rest.groupBy("g").applyInPandas(run, "id bigint, piece int, token_start bigint, n_tokens bigint, container string")
    lone = whole.select("id", "piece", (F.col("piece").cast("bigint") * capacity).alias("token_start"), F.lit(capacity).cast("bigint").alias("n_tokens"), F.concat(F.lit("i"), F.col("id"), F.lit("-"), F.col("piece")).alias("container"))
    return packed.unionByName(lone).withColumnRenamed("id", id_column)


def pack_texts(df: DataFrame, id_column: str, text_column: str, tokenizers: str | None = None, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``pack`` with sizes in tokens of the public tokenizer."""
    return pack(token_counts(df, id_column, text_column, tokenizers), id_column, "n_tokens", capacity, group_items)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, unused, used_share) of a packing; aggregated twice with partial sums."""
    used = packed.groupBy("container").agg(F.sum("n_tokens").alias("tokens"))
    return used.agg(F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).withColumn("unused", F.col("containers") * capacity - F.col("tokens"))
