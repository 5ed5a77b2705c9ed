"""Contamination of a corpus by evaluation items: equal identifiers, equal digests, similar code, similar statements.

Items are a small dimension whose size is checked before it is sent to the workers; beyond the bound the same counts come from a
shuffled join on shingles. Rows' texts are never shuffled within the bound: what leaves the scan are the pairs that hold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import text_has_identifier
from ..functions.text import normalize_code, sha256_text
from ..functions.tokens import code_token_hashes, shingle_hash_set, token_shingles

THRESHOLD = 0.8
#: A pair whose token counts differ by more isn't compared.
LEAST_RATIO = 0.35
#: Shingles of items that are broadcast at most (16 bytes each).
BROADCAST_SHINGLES = 2_000_000
#: Item numbers that are broadcast at most.
BROADCAST_NUMBERS = 10_000


def sized_broadcast(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; as it is otherwise, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _tokenized(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), token_shingles(F.col(text)).alias("b")).select("k", "b.tokens", F.col("b.shingles").alias("s"))


def _index(items: DataFrame) -> tuple[np.ndarray, ...] | None:
    """Sorted shingles of all items, the item of each, item names, sizes and token counts; None beyond the bound."""
    exploded = items.select("k", "tokens", F.size("s").alias("size"), F.explode("s").alias("h"))
    table = exploded.limit(BROADCAST_SHINGLES + 1).toArrow()
    if table.num_rows > BROADCAST_SHINGLES:
        return None
    names = table.column("k").unique()
    number = pc.index_in(table.column("k"), names).to_numpy()
    h = table.column("h").to_numpy()
    order = np.argsort(h, kind="stable")
    first = np.unique(number, return_index=True)[1]
    size, tokens = (table.column(c).to_numpy()[first] if len(first) else np.empty(0, np.int64) for c in ("size", "tokens"))
    return h[order], number[order], names.to_pylist(), size, tokens


def similar_pairs(rows: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, least_ratio: float = LEAST_RATIO, least_similarity: float = 0.0) -> DataFrame:
    """(key, item, shared, all) of all pairs with a shingle in common, token counts within the ratio, and at least the similarity.

    Items within the bound are an index in every worker, which counts a row's shared shingles with all items at once: one
    narrow pass over the rows' texts. Beyond it the shingles of both sides are joined.
    """
    item_side = _tokenized(items, item, item_text)
    index = _index(item_side)
    if index is None:
        left = _tokenized(rows, key, text).select("k", "tokens", F.size("s").alias("size"), F.explode("s").alias("h"))
        right = item_side.select(F.col("k").alias("item"), F.col("tokens").alias("item_tokens"), F.size("s").alias("item_size"), F.explode("s").alias("h"))
        ratio = F.least("tokens", "item_tokens") / F.greatest("tokens", "item_tokens", F.lit(1))
        counted = left.join(right, "h").where(ratio >= least_ratio).groupBy("k", "item", "size", "item_size").agg(F.count("*").alias("shared"))
        pairs = counted.select(F.col("k").alias(key), F.col("item").alias(item), "shared", (F.col("size") + F.col("item_size") - F.col("shared")).cast("bigint").alias("all"))
        return pairs.where(F.col("shared") >= F.lit(least_similarity) * F.col("all"))

    sent = rows.sparkSession.sparkContext.broadcast(index)
    kind, item_kind = rows.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number, names, sizes, lengths = sent.value
        name_array = pa.array(names)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows_at, found, shared, union = [], [], [], []
                for i, x in enumerate(part.column("x").to_pylist()):
                    tokens = code_token_hashes(x)
                    own = shingle_hash_set(tokens)
                    low = np.searchsorted(hashes, own, "left")
                    many = np.searchsorted(hashes, own, "right") - low
                    total = int(many.sum())
                    if not total:
                        continue
                    which = number[np.repeat(low - np.cumsum(many) + many, many) + np.arange(total)]
                    common = np.bincount(which, minlength=len(names))
                    every = len(own) + sizes - common
                    ratio = np.minimum(lengths, len(tokens)) / np.maximum(np.maximum(lengths, len(tokens)), 1)
                    good = np.flatnonzero((common > 0) & (ratio >= least_ratio) & (common >= least_similarity * every))
                    rows_at.append(np.full(len(good), i))
                    found.append(good)
                    shared.append(common[good])
                    union.append(every[good])
                if rows_at:
                    yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(np.concatenate(rows_at))), name_array.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(shared), pa.int64()), pa.array(np.concatenate(union), pa.int64())], names=["k", "item", "shared", "all"])

    read = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("x"))
    return read.mapInArrow(run, f"k {kind}, item {item_kind}, shared bigint, all bigint").withColumnsRenamed({"k": key, "item": item})


def named_items(rows: DataFrame, keys: list[str], text: str, items: DataFrame, item: str, number: str) -> DataFrame:
    """(keys, item) of all rows whose text has an item's number in it, bounded; ``keys`` are unique.

    An equi-join on the longest run of letters and digits of the number, which is a whole run of any such text, then the test. Numbers
    within the bound are broadcast and texts stay where they are; beyond it runs are shuffled, and texts only of rows that share one.
    """
    runs = F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.col(text), F.lit("[A-Za-z0-9]+"), 0))))
    longest = F.array_max(F.transform(F.regexp_extract_all(F.lower(number), F.lit("[a-z0-9]+"), 0), lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
    numbers = items.where(F.length(number) >= 3).select(F.col(item).alias("_item"), F.col(number).alias("_number"), F.coalesce(longest, F.lit("")).alias("_run"))
    read = rows.where(F.col(text).isNotNull())
    if numbers.limit(BROADCAST_NUMBERS + 1).count() <= BROADCAST_NUMBERS:
        met = read.select(*keys, F.col(text).alias("_x"), runs.alias("_r")).withColumn("_run", F.lower("_r")).join(F.broadcast(numbers), "_run")
    else:
        shared = read.select(*keys, runs.alias("_r")).withColumn("_run", F.lower("_r")).join(numbers, "_run").select(*keys, "_item", "_number").distinct()
        met = shared.join(read.select(*keys, F.col(text).alias("_x")), keys)
    return met.where(text_has_identifier(F.col("_x"), F.col("_number"))).select(*keys, F.col("_item").alias(item)).distinct()


def contamination(rows: DataFrame, key: str, problem: str, code: str, statement: str, items: DataFrame, item: str, item_problem: str, item_code: str, item_statement: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, item, reasons, code_shared, code_all, statement_shared, statement_all) of contaminated rows.

    Reasons: problem_id, sha256 (of the text as it is or normalised), code_similarity, statement_similarity.
    """

    def by(reason: str, left: Column, right: Column) -> DataFrame:
        a = rows.select(F.col(key).alias("rk"), left.alias("v")).where("v is not null")
        b = items.select(F.col(item).alias("ik"), right.alias("v")).where("v is not null").distinct()
        return a.join(b, "v").select("rk", "ik", F.lit(reason).alias("reason"), *[F.lit(None).cast("bigint").alias(c) for c in ("cs", "ca", "ss", "sa")]).distinct()

    def near(reason: str, text: str, item_text: str, own: tuple[str, str]) -> DataFrame:
        pairs = similar_pairs(rows.select(F.col(key).alias("rk"), F.col(text).alias("x")), "rk", "x", items.select(F.col(item).alias("ik"), F.col(item_text).alias("x")), "ik", "x", least_similarity=threshold)
        return pairs.select("rk", "ik", F.lit(reason).alias("reason"), *[(F.col("shared") if c == own[0] else F.col("all") if c == own[1] else F.lit(None)).cast("bigint").alias(c) for c in ("cs", "ca", "ss", "sa")])

    evidence = (
        by("problem_id", F.upper(F.col(problem)), F.upper(F.col(item_problem)))
        .unionByName(by("sha256", sha256_text(normalize_code(F.col(code))), sha256_text(normalize_code(F.col(item_code)))))
        .unionByName(near("code_similarity", code, item_code, ("cs", "ca")))
        .unionByName(near("statement_similarity", statement, item_statement, ("ss", "sa")))
    )
    return evidence.groupBy("rk", "ik").agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.max("cs").alias("code_shared"), F.max("ca").alias("code_all"), F.max("ss").alias("statement_shared"), F.max("sa").alias("statement_all")).withColumnsRenamed({"rk": key, "ik": item})


def item_evidence(rows: DataFrame, key: str, path: str, text: str, digest: str, items: DataFrame, item: str, number: str, code: str, in_paths: DataFrame, threshold: float = THRESHOLD, most: int = 10) -> DataFrame:
    """(item, matched, reason, records, max_similarity, first_records) of every item: the evidence of all records, merged.

    Evidence of a record: path (``in_paths``, from (key, item)), problem_id (the item's number in the whole text, bounded), sha256 (of the item's code as it
    is or normalised), similarity. The greatest similarity counts records without evidence too. Records are ranked before a bounded list is made of them.
    """
    from pyspark.sql import Window

    keys = [key]
    named = named_items(rows.select(*keys, text), keys, text, items.select(F.col(item).alias("item"), number), "item", number)
    raw, normal = sha256_text(F.col(code)), sha256_text(normalize_code(F.col(code)))
    digests = items.select(F.col(item).alias("item"), F.explode(F.array_distinct(F.array(raw, normal))).alias("d")).unionByName(items.select(F.col(item).alias("item"), F.concat(F.lit("n:"), normal).alias("d")))
    own = rows.select(key, F.explode(F.array_compact(F.array(F.col(digest), F.concat(F.lit("n:"), sha256_text(normalize_code(F.col(text))))))).alias("d"))
    equal = own.join(digests, "d").select(key, "item")
    near = similar_pairs(rows.select(key, text), key, text, items.select(F.col(item).alias("item"), F.col(code).alias("_code")), "item", "_code")
    near = near.select(key, "item", (F.col("shared").cast("double") / F.col("all")).alias("s"), (F.col("shared") >= threshold * F.col("all")).alias("hit"))
    evidence = [(in_paths, "path"), (named, "problem_id"), (equal, "sha256"), (near.where("hit"), "similarity")]
    every = None
    for found, reason in evidence:
        part = found.select(key, "item", F.lit(reason).alias("reason"))
        every = part if every is None else every.unionByName(part)
    records = every.groupBy("item", key).agg(F.collect_set("reason").alias("reasons"))
    first = records.withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy(key))).where(F.col("_r") <= most)
    first = first.groupBy("item").agg(F.array_sort(F.collect_list(key)).alias("first_records"))
    merged = records.select("item", key, F.explode("reasons").alias("reason")).groupBy("item").agg(F.array_sort(F.collect_set("reason")).alias("all_reasons"))
    counted = records.groupBy("item").agg(F.count("*").alias("records"))
    greatest = near.groupBy("item").agg(F.max("s").alias("max_similarity"))
    out = items.select(F.col(item).alias("item"))
    for side in (merged, counted, greatest, first):
        out = out.join(side, "item", "left")
    reasons = F.coalesce(F.array_join("all_reasons", ","), F.lit("none"))
    kind = rows.schema[key].dataType.simpleString()
    return out.select(
        "item", F.col("records").isNotNull().alias("matched"), reasons.alias("reason"), F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"), F.coalesce("first_records", F.array().cast(f"array<{kind}>")).alias("first_records"),
    )
