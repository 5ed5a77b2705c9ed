"""Exact duplicates by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, digest: Column, order: list[str]) -> DataFrame:
    """(digest, rows, order...): the first row's ``order`` columns of each digest.

    An aggregate with a minimum of a struct instead of a window: it combines before the shuffle and no digest's rows meet in one task.
    """
    first = F.min(F.struct(*order))
    found = df.groupBy(digest.alias("digest")).agg(F.count("*").alias("rows"), first.alias("first"))
    return found.select("digest", "rows", *[F.col("first")[c].alias(c) for c in order])


def duplicate_groups(df: DataFrame, digest: Column, member: str) -> DataFrame:
    """(digest, rows, first_member, last_member) of digests with more than one row; members join back by digest."""
    return df.groupBy(digest.alias("digest")).agg(F.count("*").alias("rows"), F.min(member).alias("first_member"), F.max(member).alias("last_member")).where("rows > 1")


def members(df: DataFrame, digest: Column, groups: DataFrame, member: str) -> DataFrame:
    """(digest, member): one row per member of each group, never one list per group."""
    return df.select(digest.alias("digest"), F.col(member)).join(groups.select("digest"), "digest", "left_semi")


def accumulated(df: DataFrame, key: Column, sets: list[str]) -> DataFrame:
    """(key, <set>...): distinct values met with each key, sorted. For bounded sets such as split names."""
    return df.groupBy(key.alias("key")).agg(*[F.array_sort(F.collect_set(s)).alias(s) for s in sets])
