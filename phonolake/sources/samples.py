"""Sample tables: loading and the rejects split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonolake.functions.levels import is_finite

SAMPLES = T.StructType([
    T.StructField("rec_id", T.LongType()),
    T.StructField("ch", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("v", T.DoubleType()),
])


def recording_states(samples: DataFrame) -> DataFrame:
    """One row per recording with the first reason it cannot be used, or 'ok'."""
    per_channel = samples.groupBy("rec_id", "ch").agg(
        F.count(F.lit(1)).alias("frames"),
        F.min("n").alias("lo"),
        F.max("n").alias("hi"),
        F.count_if(~is_finite(F.col("v"))).alias("bad"),
    )
    return per_channel.groupBy("rec_id").agg(
        F.count(F.lit(1)).alias("channels"),
        F.max("frames").alias("frames"),
        F.when(F.min("frames") != F.max("frames"), "unequal channel lengths")
        .when((F.min("lo") != 0) | (F.max("hi") != F.max("frames") - 1), "missing positions")
        .when(F.sum("bad") > 0, "non-finite samples")
        .otherwise("ok")
        .alias("state"),
    )


def load_samples(spark: SparkSession, path: str, recordings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(good samples, rejects with reason). ``recordings(rec_id, sample_rate)`` adds the rate check."""
    samples = spark.read.schema(SAMPLES).parquet(path)
    states = recording_states(samples)
    if recordings is not None:
        rate = F.coalesce(F.col("sample_rate"), F.lit(0))
        states = states.join(recordings.select("rec_id", "sample_rate"), "rec_id", "left").withColumn(
            "state", F.when((F.col("state") == "ok") & (rate <= 0), "no sample rate").otherwise(F.col("state"))
        )
    good = samples.join(states.filter("state = 'ok'"), "rec_id", "left_semi")
    return good, states.filter("state <> 'ok'").select("rec_id", F.col("state").alias("reason"))
