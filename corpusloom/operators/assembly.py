"""Assembling pairs from several tables with a reason for each row that can't be used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_lookup(df: DataFrame, other: DataFrame, on: list[str], columns: list[str], prefix: str) -> DataFrame:
    """Left join with the other side's columns prefixed, and ``<prefix>found``. The other side must have one row per key."""
    side = other.select(*on, *[F.col(c).alias(f"{prefix}{c}") for c in columns], F.lit(True).alias(f"{prefix}found"))
    return df.join(side, on, "left").withColumn(f"{prefix}found", F.coalesce(f"{prefix}found", F.lit(False)))


def one_per_key(df: DataFrame, on: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The first row of each key by ``order``, by an aggregate."""
    first = F.min(F.struct(*order, *[c for c in columns if c not in order]))
    return df.where(" and ".join(f"`{k}` is not null" for k in on)).groupBy(*on).agg(first.alias("_f")).select(*on, *[F.col("_f")[c].alias(c) for c in columns])


def routed(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """``df`` with ``reason``: the first that applies, null for rows that pass."""
    out = None
    for name, condition in reasons.items():
        test = F.coalesce(condition, F.lit(False))
        out = F.when(test, name) if out is None else out.when(test, name)
    return df.withColumn("reason", out)


def fallback_chain(df: DataFrame, levels: list[tuple[DataFrame, list[str], str]], alias: str) -> DataFrame:
    """``df`` with the first found value of several lookups (table, keys, column), and the level it comes from."""
    out, names = df, []
    for i, (other, on, column) in enumerate(levels):
        names.append(f"_v{i}")
        out = out.join(other.select(*on, F.col(column).alias(f"_v{i}")), on, "left")
    level = reduce(lambda acc, i: acc.when(F.col(names[i]).isNotNull(), i), range(1, len(names)), F.when(F.col(names[0]).isNotNull(), 0))
    return out.withColumn(alias, F.coalesce(*names)).withColumn(f"{alias}_level", level).drop(*names)


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """(stage, ord, attempted, kept, dropped): rows that pass each condition and all before it, in one pass."""
    ordered = list(stages.items())
    passed, columns = F.lit(True), []
    for i, (_, condition) in enumerate(ordered):
        passed = passed & F.coalesce(condition, F.lit(False))
        columns.append(F.count_if(passed).alias(f"s{i}"))
    counted = df.agg(F.count("*").alias("total"), *columns)
    rows = [F.struct(F.lit(name).alias("stage"), F.lit(i).alias("ord"), F.col("total" if i == 0 else f"s{i - 1}").alias("attempted"), F.col(f"s{i}").alias("kept")) for i, (name, _) in enumerate(ordered)]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("dropped", F.col("attempted") - F.col("kept"))


def version_diff(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """(shared, same, changed, left_only, right_only) over keys, each side with one row per key; null digests differ from others."""
    both = left.select(key, F.col(digest).alias("l"), F.lit(1).alias("in_l")).join(right.select(key, F.col(digest).alias("r"), F.lit(1).alias("in_r")), key, "full_outer")
    shared = F.col("in_l").isNotNull() & F.col("in_r").isNotNull()
    same = shared & F.col("l").eqNullSafe(F.col("r"))
    return both.agg(F.count_if(shared).alias("shared"), F.count_if(same).alias("same"), F.count_if(shared & ~same).alias("changed"), F.count_if(F.col("in_r").isNull()).alias("left_only"), F.count_if(F.col("in_l").isNull()).alias("right_only"))
