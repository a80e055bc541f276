"""Transcript documents: JSON in, validated and shifted lines out, with rejects by reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonolake.operators.ordered import previous_row, slice_no

WORD = T.StructType([
    T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()),
    T.StructField("word", T.StringType()), T.StructField("probability", T.DoubleType()),
])
LINE = T.StructType([
    T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()),
    T.StructField("text", T.StringType()), T.StructField("needs_review", T.BooleanType()),
    T.StructField("words", T.ArrayType(WORD)),
])
TRANSCRIPT = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("source_title", T.StringType()),
    T.StructField("range_start", T.DoubleType()), T.StructField("range_end", T.DoubleType()),
    T.StructField("language", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("lines", T.ArrayType(LINE)),
])


def parse_transcripts(documents: DataFrame) -> DataFrame:
    """documents(rec_id, json) to one row per line; unreadable documents keep a row with a NULL version."""
    t = documents.select("rec_id", F.from_json("json", TRANSCRIPT).alias("t"))
    return t.select(
        "rec_id", F.col("t.schema_version").alias("schema_version"), F.size("t.lines").alias("line_count"),
        F.posexplode_outer("t.lines").alias("line_no", "line"),
    ).select("rec_id", "schema_version", "line_count", F.col("line_no").cast("long").alias("line_no"), "line.*")


def line_problem() -> Column:
    start, end, limit = F.col("start"), F.col("end"), F.col("duration")
    bad_word = F.exists(
        "words",
        lambda w: w["start"].isNull() | w["end"].isNull() | w["probability"].isNull()
        | (w["start"] < start - 0.25) | (w["end"] > F.least(limit, end) + 0.25) | (w["end"] < w["start"])
        | (w["probability"] < 0) | (w["probability"] > 1),
    )
    return (
        F.when(
            F.col("schema_version").isNull() | (F.col("schema_version") != 1),
            "unsupported transcript",
        )
        .when(
            start.isNull() | end.isNull() | (start < 0) | (start < F.coalesce("prev_start", F.lit(0.0)))
            | (end <= start) | (end > limit + 0.25) | F.col("text").isNull() | F.col("words").isNull(),
            "invalid line timings",
        )
        .when(start >= F.least(limit, end), "line outside the audio range")
        .when(bad_word, "invalid word timings")
    )


def ingest(lines: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines on the document timeline, rejected recordings with their first problem).

    ``ranges(rec_id, offset, duration)``. One bad line rejects its recording, as replaying half a transcript would
    misplace the rest.
    """
    checked = previous_row(
        lines.join(ranges, "rec_id"), ["rec_id"], slice_no("line_no", 4096), ["line_no"], ["start"]
    ).withColumn("problem", line_problem())
    rejects = checked.filter(F.col("problem").isNotNull()).groupBy("rec_id").agg(
        F.min_by("problem", "line_no").alias("reason")
    )
    shift = F.col("offset")
    good = checked.join(rejects, "rec_id", "left_anti").select(
        "rec_id", "line_no", (F.col("start") + shift).alias("start"),
        (F.least("duration", "end") + shift).alias("end"), "text", "needs_review",
        F.transform("words", lambda w: F.struct(
            (w["start"] + shift).alias("start"), (w["end"] + shift).alias("end"), w["word"].alias("word"),
            w["probability"].alias("probability"))).alias("words"),
    )
    return good, rejects


def to_documents(lines: DataFrame) -> DataFrame:
    """One JSON document per recording from a line table with (start, end, text, needs_review, words)."""
    entry = F.struct("line_no", F.struct("start", "end", "text", "needs_review", "words").alias("l"))
    return lines.groupBy("rec_id").agg(F.array_sort(F.collect_list(entry)).alias("_l")).select(
        "rec_id",
        F.to_json(F.struct(F.lit(1).alias("schema_version"), F.transform("_l", lambda x: x["l"]).alias("lines"))).alias("json"),
    )
