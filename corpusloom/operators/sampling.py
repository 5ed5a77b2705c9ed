"""Deterministic splits and samples by hash order.

A global position in hash order without a single-partition window: keys go to buckets of equal hash ranges, bucket sizes are counted
(a table of ``buckets`` rows), and a row's position is its rank within its bucket plus the sizes of the buckets before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeage import hash_unit

#: Buckets of hash order; a bucket of a table of 10^10 rows holds 2.4 million keys of 64 characters.
BUCKET_DIGITS = 3


def hash_key(seed: str, *parts: Column) -> Column:
    """SHA-256 of "seed:part:part" in hexadecimal."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *parts), 256)


def hash_positions(df: DataFrame, key: Column, tie: str, digits: int = BUCKET_DIGITS) -> DataFrame:
    """``df`` with ``position`` (from 1) in the order of (key, tie), and ``total``."""
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # At most 16^digits rows: this window is over bucket sizes, not over the data.
    before = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    placed = keyed.join(F.broadcast(before), "_bucket").withColumn("position", F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", tie)) + F.col("_before"))
    return placed.drop("_key", "_bucket", "_before")


def hash_split(df: DataFrame, key: Column, tie: str, share: float = 0.1, least: int = 10, names: tuple[str, str] = ("val", "train")) -> DataFrame:
    """``df`` with ``split``: the first round(share n) rows in hash order are held out, half to even; none below ``least`` rows."""
    held = F.when(F.col("total") >= least, F.bround(F.col("total") * F.lit(share), 0)).otherwise(0)
    return hash_positions(df, key, tie).withColumn("split", F.when(F.col("position") <= held, names[0]).otherwise(names[1])).drop("position", "total")


def three_way_split(df: DataFrame, key: Column, tie: str, train: float = 0.9, validation: float = 0.05) -> DataFrame:
    """``df`` with ``split`` by truncated shares in hash order: train, validation, and test with the rest."""
    first, second = F.floor(F.col("total") * train), F.floor(F.col("total") * train) + F.floor(F.col("total") * validation)
    return hash_positions(df, key, tie).withColumn("split", F.when(F.col("position") <= first, "train").when(F.col("position") <= second, "validation").otherwise("test")).drop("position", "total")


def acceptance_sample(df: DataFrame, seed: str, key: Column, probability: Column) -> DataFrame:
    """Rows kept with their probability, without replacement: a filter, no shuffle."""
    return df.where(hash_unit(seed, key) < probability)


def weighted_draws(df: DataFrame, key: str, weight: str, draws: int | None, seed: str, digits: int = BUCKET_DIGITS) -> DataFrame:
    """(draw, key): ``draws`` draws with replacement (None: as many as there are rows), each row with a chance in proportion to its whole-number weight.

    Cumulative weights stand in hash buckets of the key. [0, total) is cut into as many cells as there can be buckets; a draw's number finds
    its bucket by an equi-join on the cell, as each bucket says which cells it lies in, then its row by an equi-join on the bucket and a range within it.
    """
    rows = df.where(F.col(weight) > 0).select(F.col(key).alias("k"), F.col(weight).cast("bigint").alias("w")).withColumn("b", F.substring(F.sha2(F.col("k").cast("string"), 256), 1, digits))
    sums = rows.groupBy("b").agg(F.sum("w").alias("bw"), F.count("*").alias("bn"))
    total, count = sums.agg(F.coalesce(F.sum("bw"), F.lit(0)), F.coalesce(F.sum("bn"), F.lit(0))).first()
    cells = 16**digits
    # A few thousand buckets whatever the size of the data, so this window and the broadcast have that bound.
    upto = F.sum("bw").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    placed = sums.select("b", (upto - F.col("bw")).alias("lo"), upto.alias("hi"))

    def cell(at: Column) -> Column:
        return F.floor(at.cast("double") * cells / max(1, total)).cast("bigint")

    buckets = F.broadcast(placed.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi"))))))
    numbers = df.sparkSession.range(count if draws is None else draws).select(F.col("id").alias("draw"), F.floor(hash_unit(seed, F.col("id").cast("string")) * F.lit(total)).alias("at")).withColumn("cell", cell(F.col("at")))
    in_bucket = numbers.join(buckets, "cell").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("draw", "b", (F.col("at") - F.col("lo")).alias("rest"))
    within = F.sum("w").over(Window.partitionBy("b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    ranges = rows.withColumn("w_hi", within).withColumn("w_lo", F.col("w_hi") - F.col("w"))
    met = in_bucket.join(ranges, "b").where((F.col("rest") >= F.col("w_lo")) & (F.col("rest") < F.col("w_hi")))
    return met.select("draw", F.col("k").alias(key))


def uniform_sample(df: DataFrame, key: Column, tie: str, k: int) -> DataFrame:
    """The first ``k`` of all rows in hash order, then in the order of ``tie``: a top-k, so partitions send k rows each."""
    return df.withColumn("_key", key).orderBy("_key", tie).limit(k).drop("_key").orderBy(tie)


def sample_per_stratum(df: DataFrame, stratum: str, key: Column, tie: str, k: int) -> DataFrame:
    """The first ``k`` rows of each stratum in hash order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy(key, tie)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def stratified_quota(df: DataFrame, stratum: Column, key: Column, tie: str, size: int, first: str, second: str) -> DataFrame:
    """``size`` rows: at most half from stratum ``first``, the rest from ``second``, what is then missing from all others, each in hash order."""
    ranked = df.withColumn("_s", F.when(stratum == first, 0).when(stratum == second, 1).otherwise(2)).withColumn("_key", key)
    heads = [ranked.where(F.col("_s") == 0).orderBy("_key", tie).limit(size // 2), ranked.where(F.col("_s") == 1).orderBy("_key", tie).limit(size)]
    # Only heads of at most ``size`` rows are left, so this window is over a bounded number of rows.
    rest = ranked.join(heads[0].select(tie), tie, "left_anti").withColumn("_late", F.when(F.col("_s") == 1, 0).otherwise(1)).orderBy("_late", "_key", tie).limit(size)
    order = Window.partitionBy().orderBy("_part", "_late", "_key", tie)
    both = heads[0].withColumn("_late", F.lit(0)).withColumn("_part", F.lit(0)).unionByName(rest.withColumn("_part", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size).drop("_n", "_part", "_late", "_s", "_key")
