"""Comparisons of conditions over the same keys: grouping sets, transitions, quantifiers, deltas, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouping_summary(df: DataFrame, sets: list[list[str]], flags: dict[str, Column]) -> DataFrame:
    """(columns..., level, total, <flag>...) for several grouping sets in one pass; ``level`` lists the set's columns."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    view = df.select(*columns, *[c.cast("boolean").alias(n) for n, c in flags.items()])
    grouped = view.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns]).alias("level"), F.count("*").alias("total"), *[F.count_if(n).alias(n) for n in flags])
    return grouped


def paired_conditions(df: DataFrame, keys: list[str], condition: str, left: str, right: str, values: list[str]) -> DataFrame:
    """One row per key with the values of both conditions (l_, r_): one aggregation instead of a self-join."""
    picks = [F.max(F.when(F.col(condition) == side, F.col(v))).alias(f"{p}_{v}") for side, p in ((left, "l"), (right, "r")) for v in values]
    return df.where(F.col(condition).isin(left, right)).groupBy(*keys).agg(*picks)


def transitions(df: DataFrame, keys: list[str], condition: str, left: str, right: str, status: str) -> DataFrame:
    """(transition, n): how often a key's status changes from one condition to the other, for changed keys."""
    pairs = paired_conditions(df, keys, condition, left, right, [status])
    changed = pairs.where(F.col(f"l_{status}") != F.col(f"r_{status}"))
    return changed.groupBy(F.concat_ws("->", f"l_{status}", f"r_{status}").alias("transition")).agg(F.count("*").alias("n"))


def gained_lost(df: DataFrame, keys: list[str], condition: str, left: str, right: str, passed: str) -> DataFrame:
    """(keys..., change) of keys that pass in one of the two conditions only."""
    pairs = paired_conditions(df, keys, condition, left, right, [passed])
    l, r = F.coalesce(f"l_{passed}", F.lit(False)), F.coalesce(f"r_{passed}", F.lit(False))
    return pairs.select(*keys, F.when(~l & r, "gained").when(l & ~r, "lost").alias("change")).where("change is not null")


def quantified(df: DataFrame, key: str, condition: str, passed: str, baseline: str) -> DataFrame:
    """(key, any, all, none, differ, recovered, regressed) over all conditions of each key.

    recovered: the baseline fails and some condition passes; regressed: the baseline passes and some fails.
    """
    p = F.coalesce(F.col(passed), F.lit(False))
    base = F.coalesce(F.bool_or(F.when(F.col(condition) == baseline, p)), F.lit(False))
    found = df.groupBy(key).agg(F.bool_or(p).alias("any_pass"), F.bool_and(p).alias("all_pass"), base.alias("base"))
    return found.select(key, "any_pass", "all_pass", (~F.col("any_pass")).alias("none_pass"), (F.col("any_pass") & ~F.col("all_pass")).alias("differ"), (~F.col("base") & F.col("any_pass")).alias("recovered"), (F.col("base") & ~F.col("all_pass")).alias("regressed"))


def delta_table(counts: DataFrame, group: str, key: str, baseline: str) -> DataFrame:
    """(group, key, hits, n, base_hits, base_n): each group beside the baseline, from (group, key, hits, n)."""
    base = counts.where(F.col(group) == baseline).select(key, F.col("hits").alias("base_hits"), F.col("n").alias("base_n"))
    return counts.where(F.col(group) != baseline).join(base, key)


def scoped(df: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """``df`` once per scope that a row is in, with the scope's name: overlapping groups without several scans."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in scopes.items()]))
    return df.withColumn("scope", F.explode(names))


def best_groups(means: DataFrame, group: str, score: str) -> DataFrame:
    """The groups with the greatest score, ties included."""
    # One row per group: a window over a report, not over data.
    return means.withColumn("_top", F.max(score).over(Window.partitionBy())).where(F.col(score) == F.col("_top")).drop("_top")


def first_case(cases: Column, test) -> Column:
    """The first case of an array for which ``test`` holds; null if none."""
    return F.try_element_at(F.filter(cases, test), F.lit(1))


def distinct_statuses(df: DataFrame, cases: str, field: str) -> DataFrame:
    """(status, records): in how many records each case status occurs."""
    return df.select(F.explode(F.array_distinct(F.transform(F.col(cases), lambda c: c[field]))).alias("status")).groupBy("status").agg(F.count("*").alias("records"))
