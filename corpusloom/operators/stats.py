"""Summaries: rates, three percentile definitions, truncation tables, zero-filled distributions, shifts.

Exact percentiles at scale: values are first counted per value (partial aggregation), so the ordered pass sees distinct values
only; token lengths and the like have few, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rates(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """(by..., total, <flag>..., <flag>_rate...) with rates of 0 where there are no rows."""
    counted = df.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    return counted.select("*", *[F.when(F.col("total") > 0, F.col(n) / F.col("total")).otherwise(0.0).alias(f"{n}_rate") for n in flags])


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def _ranked(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., v, c, upto, n): distinct values with their counts and running counts; nulls don't count.

    Nulls are left out by the sums: a filter would be pushed below the projection and compute a costly value twice.
    """
    counts = df.groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    keys = by or [F.lit(0)]
    real = F.sum(F.when(F.col("v").isNotNull(), F.col("c")))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("upto", real.over(order)).withColumn("n", real.over(Window.partitionBy(*keys)))


def _at(rank: Column) -> Column:
    """The value at a 0-based rank."""
    return F.min(F.when(F.col("upto") > rank, F.col("v")))


def nearest_rank(df: DataFrame, value: str, fractions: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Percentiles at rank ceil(p n)."""
    ranked = _ranked(df, value, list(by))
    return ranked.groupBy(*by).agg(*[_at(F.greatest(F.ceil(F.col("n") * p), F.lit(1)) - 1).alias(name) for name, p in fractions.items()])


def floor_index(df: DataFrame, value: str, fractions: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Quantiles at index floor(q (n - 1)); the median is the lower one."""
    ranked = _ranked(df, value, list(by))
    return ranked.groupBy(*by).agg(*[_at(F.floor((F.col("n") - 1) * p)).alias(name) for name, p in fractions.items()])


def interpolated(df: DataFrame, value: str, fractions: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Percentiles by linear interpolation between the ranks around p (n - 1)."""
    ranked = _ranked(df, value, list(by))
    place = {name: (F.col("n") - 1) * p for name, p in fractions.items()}
    ends = ranked.groupBy(*by).agg(*[_at(F.floor(x)).alias(f"{n}_lo") for n, x in place.items()], *[_at(F.ceil(x)).alias(f"{n}_hi") for n, x in place.items()], F.max("n").alias("n"))
    return ends.select(*by, *[(F.col(f"{n}_lo") * (1 - (x - F.floor(x))) + F.col(f"{n}_hi") * (x - F.floor(x))).alias(n) for n, x in place.items()])


def numeric_summary(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by..., n, total, minimum, maximum, mean, median) from distinct values with counts: the mean from exact sums, the median by interpolation."""
    ranked = _ranked(df, value, list(by))
    middle = (F.col("n") - 1) * 0.5
    summed = ranked.groupBy(*by).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.sum(F.col("v") * F.col("c")).alias("total"), F.min("v").alias("minimum"), F.max("v").alias("maximum"),
        _at(F.floor(middle)).alias("_lo"), _at(F.ceil(middle)).alias("_hi"),
    )
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    return summed.select(*by, "n", "total", "minimum", "maximum", mean.alias("mean"), ((F.col("_lo") + F.col("_hi")) / 2).alias("median"))


def truncation_table(df: DataFrame, length: str, limits: list[int]) -> DataFrame:
    """(max_length, samples, truncated, tokens, lost): what each limit would cut, in one pass over the data."""
    each = df.select(F.col(length).cast("bigint").alias("l"), F.explode(F.array(*[F.lit(x) for x in limits])).alias("max_length"))
    return each.groupBy("max_length").agg(F.count("l").alias("samples"), F.count_if(F.col("l") > F.col("max_length")).alias("truncated"), F.sum("l").alias("tokens"), F.sum(F.when(F.col("l") > F.col("max_length"), F.col("l") - F.col("max_length")).otherwise(0)).alias("lost"))


def length_bands(length: Column, bounds: list[int]) -> Column:
    """Name of the band of a length: inclusive upper bounds, and one beyond."""
    out, below = None, None
    for b in bounds:
        name = f"<={b}" if below is None else f"{below + 1}-{b}"
        out = F.when(length <= b, name) if out is None else out.when(length <= b, name)
        below = b
    return out.when(length > below, f">{below}")


def zero_filled(dimension: DataFrame, facts: DataFrame, key: str, aggregates: dict[str, Column]) -> DataFrame:
    """All rows of a small dimension with aggregates of the facts, 0 where there are none. Facts are aggregated before the join."""
    counted = facts.groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items()])
    joined = dimension.join(counted, key, "left")
    return joined.select(*dimension.columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in aggregates])


def prevalence_shift(prevalence: DataFrame, group: str, recent: str, baseline: str, material: float = 10.0, clear: int = 3) -> DataFrame:
    """(feature, recent_hits, recent_n, baseline_hits, baseline_n, material, clear_shift) from (group, feature, hits, n).

    A feature's shift is material from ``material`` percentage points on; a clear one needs ``clear`` material features.
    """

    def of(name: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(group) == name, F.col(column))), F.lit(0))

    sides = prevalence.groupBy("feature").agg(of(recent, "hits").alias("recent_hits"), of(recent, "n").alias("recent_n"), of(baseline, "hits").alias("baseline_hits"), of(baseline, "n").alias("baseline_n"))
    # |a/b - c/d| >= m/100 in whole numbers.
    gap = F.abs(F.col("recent_hits") * F.col("baseline_n") - F.col("baseline_hits") * F.col("recent_n")) * 100
    flagged = sides.withColumn("material", gap >= F.lit(material) * F.col("recent_n") * F.col("baseline_n"))
    # A row per feature is left: this window is over a handful of rows.
    return flagged.withColumn("clear_shift", F.count_if("material").over(Window.partitionBy()) >= clear)


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """(value, n): the k most common values, ties by value."""
    return value_counts(df, column).orderBy(F.desc("n"), column).limit(k)
