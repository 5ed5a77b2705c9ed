"""Best versions and extremes by composite keys, as aggregates that combine before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def best_version(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """(keys..., versions, keep...) of the row with the greatest ``order`` in each group. The order must tell all rows apart."""
    named = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    best = df.groupBy(*keys).agg(F.count("*").alias("versions"), F.max(F.struct(*named, *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)])).alias("_best"))
    return best.select(*keys, "versions", *[F.col(f"_best._k{i}").alias(k) for i, k in enumerate(keep)])


def losing_versions(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """(keys..., place, keep...) of all rows but each group's best, with their place from 2 on: rows, not a list per group.

    Rows are dealt by ranges of (keys, order), so a group of any size spreads over tasks; a row's place is that within its part and
    what earlier parts have of the group.
    """
    best_first = [o.desc() for o in order]
    parts = materialize(df.repartitionByRange(*keys, *best_first).withColumn("_part", F.spark_partition_id()), "ranges")
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_at"), "_before")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_part") == F.col("_at"))
    met = parts.join(counts, same)
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*best_first)) + F.col("_before")
    return met.withColumn("place", place.cast("int")).where("place > 1").select(*keys, "place", *keep)


def extremes(df: DataFrame, value: Column, tie: str, by: list[str] = ()) -> DataFrame:
    """(by..., least, least_at, greatest, greatest_at): arg-min and arg-max; ties by the smaller and the larger key."""
    pair = F.struct(value.alias("v"), F.col(tie).alias("t"))
    found = df.where(value.isNotNull()).groupBy(*by).agg(F.min(pair).alias("lo"), F.max(pair).alias("hi"))
    return found.select(*by, F.col("lo.v").alias("least"), F.col("lo.t").alias("least_at"), F.col("hi.v").alias("greatest"), F.col("hi.t").alias("greatest_at"))


def versions_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, keys_with_versions, rows_in_them): keys with several rows, and how many rows those have."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("keys_with_versions"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_them"))


def in_fixed_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows sorted by a given order of names first, then by name."""
    place = F.coalesce(F.try_element_at(F.create_map(*[x for i, n in enumerate(order) for x in (F.lit(n), F.lit(i))]), F.col(column)), F.lit(len(order)))
    return df.orderBy(place, column)
