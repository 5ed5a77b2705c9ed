"""Functions by name, for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources.readers import decoded
from .features import mask_literals
from .html import statement_page
from .tokens import token_shingles

#: Names under which vectorised functions can be called in SQL.
FUNCTIONS = {"mask_literals": mask_literals, "statement_page": statement_page, "decode_text": decoded, "token_shingles": token_shingles}


@udtf(returnType="chunk_index int, token_start int, token_end int")
class ChunkSpans:
    """Spans of overlapping chunks of a number of tokens."""

    def eval(self, tokens: int, size: int, overlap: int, least: int):
        if tokens is None or tokens < least:
            return
        for i, start in enumerate(range(0, max(tokens - overlap - 1, 0) + 1, size - overlap)):
            yield i, start, min(start + size, tokens)


def register_all(spark: SparkSession) -> list[str]:
    """Register everything; the names are returned."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    spark.udtf.register("chunk_spans", ChunkSpans)
    return [*FUNCTIONS, "chunk_spans"]
