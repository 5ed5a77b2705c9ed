"""Chat rendering, response-preserving truncation, loss masks and padding, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The label of a position without loss, and the marks of a turn in the default template.
NO_LOSS = -100
USER, ASSISTANT, END = "<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_end|>\n"


def prompt_text(instruction: Column) -> Column:
    """The rendered prompt up to where the answer begins."""
    return F.concat(F.lit(USER), instruction, F.lit(END), F.lit(ASSISTANT))


def full_text(instruction: Column, response: Column) -> Column:
    return F.concat(prompt_text(instruction), response, F.lit(END))


def fill_prompt(template: str, field: str, value: Column) -> Column:
    """A template with its one placeholder filled."""
    if template.count("{" + field + "}") != 1:
        raise ValueError("a template needs its placeholder exactly once")
    before, after = template.split("{" + field + "}")
    return F.concat(F.lit(before), value, F.lit(after))


def trim_prompt(ids: Column, budget: Column) -> Column:
    """At most ``budget`` ids: all, else the last ones of a small budget, else the head and a tail of at most 64."""
    tail = F.least(F.lit(64), F.floor(budget / 4).cast("int"))
    both = F.concat(F.slice(ids, F.lit(1), budget - tail), F.slice(ids, -F.greatest(tail, F.lit(1)), tail))
    last = F.slice(ids, -F.greatest(F.least(budget, F.size(ids)), F.lit(1)), F.greatest(budget, F.lit(0)))
    return F.when(budget >= F.size(ids), ids).when(budget <= 64, last).otherwise(both)


def kept_prompt_tokens(prompt: Column, response: Column, most: int) -> Column:
    """How many prompt tokens the truncation keeps, from lengths alone."""
    budget = F.when(response < most, F.lit(most) - response).otherwise(F.lit(min(256, max(32, most // 8))))
    return F.when(prompt + response <= most, prompt).otherwise(F.least(prompt, budget))


def kept_response_tokens(prompt: Column, response: Column, most: int) -> Column:
    return F.when((prompt + response <= most) | (response < most), response).otherwise(F.least(response, F.lit(most) - kept_prompt_tokens(prompt, response, most)))


def encode_pair(prompt: Column, response: Column, most: int) -> Column:
    """struct(input_ids, labels, assistant_start, original_length, truncated) of two id arrays.

    The response stays whole while it is shorter than ``most``; the prompt is trimmed to what is left. A longer response keeps
    its beginning after at most an eighth of ``most`` (32 to 256) of prompt. Labels are the response's ids only.
    """
    budget = kept_prompt_tokens(F.size(prompt), F.size(response), most)
    kept = trim_prompt(prompt, budget)
    answer = F.slice(response, F.lit(1), kept_response_tokens(F.size(prompt), F.size(response), most))
    labels = F.concat(F.array_repeat(F.lit(NO_LOSS).cast("int"), F.size(kept)), answer)
    length = F.size(prompt) + F.size(response)
    return F.struct(F.concat(kept, answer).alias("input_ids"), labels.alias("labels"), F.size(kept).alias("assistant_start"), length.alias("original_length"), (length > most).alias("truncated"))


def mask_is_right(encoded: Column) -> Column:
    """No loss on the prompt, loss on the whole answer, and an answer there is."""
    start = encoded["assistant_start"]
    masked = F.forall(F.slice(encoded["labels"], F.lit(1), start), lambda x: x == NO_LOSS)
    active = F.slice(encoded["labels"], start + 1, F.size(encoded["labels"]))
    same = active == F.slice(encoded["input_ids"], start + 1, F.size(encoded["labels"]))
    return masked & same & (F.size(active) > 0)


def pad_batches(df: DataFrame, order: list[str], size: int, partition: str, pad_id: int = 0) -> DataFrame:
    """Batches of ``size`` examples within each ``partition`` value, padded to their longest.

    Partitions keep the numbering parallel; a last batch of a partition may be smaller.
    """
    # Only keys and lengths go through the windows; the arrays join them once they are numbered.
    lengths = df.select(partition, *order, F.size("input_ids").alias("_size"))
    number = F.row_number().over(Window.partitionBy(partition).orderBy(*order)) - 1
    numbered = lengths.withColumn("batch", F.floor(number / size).cast("bigint"))
    numbered = numbered.withColumn("_longest", F.max("_size").over(Window.partitionBy(partition, "batch"))).drop("_size")
    rows = df.join(numbered, [partition, *order])
    longest = F.col("_longest")

    def padded(column: str, value: int) -> Column:
        return F.concat(F.col(column), F.array_repeat(F.lit(value).cast("int"), longest - F.size(column)))

    attention = F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), longest - F.size("input_ids")))
    return rows.select(*[c for c in rows.columns if c not in ("input_ids", "labels", "_longest")], padded("input_ids", pad_id).alias("input_ids"), padded("labels", NO_LOSS).alias("labels"), attention.alias("attention_mask"))
