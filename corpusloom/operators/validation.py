"""Expectations: rule arrays per row, and checks of keys, completeness and leakage that return what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExpectationError(RuntimeError):
    """A structural expectation doesn't hold."""


def violations(rules: dict[str, Column], gate: Column | None = None, gate_name: Column | None = None) -> Column:
    """Sorted distinct names of the rules whose condition (of being broken) is true.

    Where ``gate`` is true only ``gate_name`` is reported: what follows makes no sense there.
    """
    every = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))))
    return every if gate is None else F.when(F.coalesce(gate, F.lit(False)), F.array(gate_name)).otherwise(every)


def first_marker(text: Column, markers: list[str]) -> Column:
    """The first marker of the list that the lower-cased text has; null if none."""
    return F.try_element_at(F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(F.lower(text), m)), F.lit(1))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., rows) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def unmatched(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` without a partner in ``other``."""
    return df.join(other.select(*on).distinct(), on, "left_anti")


def expected_grid(df: DataFrame, key: str, dimensions: dict[str, list[str]]) -> DataFrame:
    """Every key of ``df`` with all combinations of short lists of names, which are exploded on the keys' rows."""
    out = df.select(key).distinct()
    for name, values in dimensions.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def completeness(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., problem): combinations that are missing, and rows that aren't expected."""
    have = actual.select(*keys).distinct()
    missing = expected.select(*keys).join(have, keys, "left_anti").withColumn("problem", F.lit("missing"))
    extra = have.join(expected.select(*keys), keys, "left_anti").withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def leaked_keys(df: DataFrame, key: str, split: str) -> DataFrame:
    """(key, splits) of keys in more than one split: one aggregation, no join."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def differing_fields(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields) where any field differs, null equal to null."""
    pairs = left.select(key, *[F.col(f).alias(f"l_{f}") for f in fields]).join(right.select(key, *[F.col(f).alias(f"r_{f}") for f in fields]), key)
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in fields]))
    return pairs.select(key, wrong.alias("fields")).where(F.size("fields") > 0)


def require_empty(df: DataFrame, message: str, show: int = 5) -> None:
    """Raise with a few of the rows if there are any."""
    if rows := df.limit(show).collect():
        raise ExpectationError(f"{message}: {[r.asDict() for r in rows]}")


def checked_names(names: list[str]) -> list[str]:
    """Names that are safe as path components and occur once."""
    bad = [n for n in names if not n or n in (".", "..") or "/" in n or "\\" in n]
    if bad or len(set(names)) < len(names) or not names:
        raise ExpectationError(f"names must be distinct path components: {bad or names}")
    return names


def audit_problems(manifest: DataFrame, texts: DataFrame, cases: DataFrame, metas: DataFrame, required: list[str], fields: list[str], checkers: list[str]) -> DataFrame:
    """(id, errors) of every problem of a manifest: missing or empty files, unpaired cases, metadata that differ, unknown checkers.

    From (id, fields...), (id, file, text), (id, suffix, input, output) and (id, key, value). Each side is aggregated to a row per
    problem before it is joined.
    """
    files = texts.groupBy("id").agg(F.collect_set(F.when(F.coalesce(F.trim("text"), F.lit("")) != "", F.col("file"))).alias("files"))
    pairs = cases.groupBy("id").agg(F.count("*").alias("cases"), F.count_if(F.col("input").isNull() | F.col("output").isNull()).alias("unpaired"))
    values = metas.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("meta"))
    joined = manifest.join(files, "id", "left").join(pairs, "id", "left").join(values, "id", "left")
    have = F.coalesce("files", F.array().cast("array<string>"))
    meta = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    rules = {f"missing_{name}": ~F.array_contains(have, name) for name in required}
    rules |= {"no_cases": F.coalesce("cases", F.lit(0)) == 0, "unpaired_cases": F.col("unpaired") > 0}
    rules |= {f"{name}_differs": ~F.try_element_at(meta, F.lit(name)).eqNullSafe(F.col(name).cast("string")) for name in fields}
    rules["unknown_checker"] = ~F.coalesce(F.try_element_at(meta, F.lit("checker.type")), F.lit("exact")).isin(checkers)
    return joined.select("id", violations(rules).alias("errors"))


def consistent(stored: DataFrame, again: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys..., fields) of results that differ from those of a second computation, or are missing on one side."""
    left = stored.select(*keys, F.struct(*fields).alias("l"))
    right = again.select(*keys, F.struct(*fields).alias("r"))
    both = left.join(right, keys, "full_outer")
    wrong = F.array_compact(F.array(*[F.when(~F.col("l")[f].eqNullSafe(F.col("r")[f]), F.lit(f)) for f in fields], F.when(F.col("l").isNull() | F.col("r").isNull(), F.lit("missing"))))
    return both.select(*keys, wrong.alias("fields")).where(F.size("fields") > 0)
