"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.textprep import recursive_pieces


class RecursiveChunks:
    def eval(self, text: str, size: int, overlap: int):
        for i, piece in enumerate(recursive_pieces(text, size, overlap) if text else []):
            yield i, piece


def register(spark: SparkSession) -> None:
    """Make ``recursive_chunks(text, size, overlap)`` usable in FROM and LATERAL."""
    spark.udtf.register("recursive_chunks", udtf(RecursiveChunks, returnType="chunk_index int, text string"))
