"""A hook for model output: any callable that is made once per task and answers batches of prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def generated(df: DataFrame, key: str, prompt: str, make: Callable[[], Callable[[list[str]], list[str]]], batch: int = 16) -> DataFrame:
    """(key, output): ``make()`` loads a model in the worker, and what it returns answers lists of prompts. Null prompts give null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = make()
        for part in batches:
            for at in range(0, part.num_rows, batch):
                rows = part.slice(at, batch)
                prompts = rows.column("p").to_pylist()
                asked = [p for p in prompts if p is not None]
                answers = iter(answer(asked) if asked else [])
                yield pa.RecordBatch.from_arrays([rows.column("k"), pa.array([None if p is None else next(answers) for p in prompts], pa.string())], names=["k", "output"])

    return df.select(F.col(key).alias("k"), F.col(prompt).alias("p")).mapInArrow(run, f"k {kind}, output string").withColumnRenamed("k", key)
