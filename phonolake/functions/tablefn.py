"""Table functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def register_split_interval(spark: SparkSession) -> None:
    """``split_interval(start, end, piece, step)``: pieces of a long interval; the native twin is ``rewindow``."""

    @udtf(returnType="piece_start double, piece_end double")
    class SplitInterval:
        def eval(self, start: float, end: float, piece: float, step: float):
            while end - start > piece:
                yield start, start + piece
                start += step
            yield start, end

    spark.udtf.register("split_interval", SplitInterval)
