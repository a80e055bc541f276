"""Capture packets as files: the batch side of the streaming source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.session import scratch_path, stage

START = "2024-01-01 00:00:00"
PER_BATCH = 150_000  # packets of all takes and channels that keyed state meets in one micro-batch


def to_packets(samples: DataFrame, frames: int, rate: int) -> DataFrame:
    """packets(take_id, seq, ts, ch, v): ``frames`` samples each, in order; a packet is a short array."""
    ordered = F.array_sort(F.collect_list(F.struct("n", "v")))
    seq = F.floor(F.col("n") / frames).cast("long")
    packed = samples.groupBy(F.col("rec_id").alias("take_id"), seq.alias("seq"), "ch").agg(ordered.alias("_s"))
    micros = F.unix_micros(F.lit(START).cast("timestamp")) + F.floor(F.col("seq") * frames * 1_000_000 / rate).cast("long")
    return packed.select(
        "take_id", "seq", F.timestamp_micros(micros).alias("ts"), "ch", F.transform("_s", lambda s: s["v"]).alias("v")
    )


def write_packets(packets: DataFrame, label: str, closing_seconds: int = 3600, per_file: int | None = None) -> str:
    """Write packets as the capture would leave them, in time order, then the closing packet as the last file.

    With ``per_file`` every file is a stretch of time of about so many packets, written after the one before it, so that a reader
    of one file per micro-batch meets them in order and never more at once.
    """
    spark = packets.sparkSession
    path = scratch_path(spark, label)
    ranged = packets.repartitionByRange("seq")
    if per_file is None:
        ranged.write.mode("append").parquet(path)
    else:
        packets = stage(ranged, f"{label}-staged")
        rows, first, last = packets.agg(F.count(F.lit(1)), F.min("seq"), F.max("seq")).first()
        width = max(1, (last - first + 1) * per_file // rows) if rows else 1
        for low in range(first, last + 1, width) if rows else ():
            packets.filter(F.col("seq").between(low, low + width - 1)).coalesce(1).write.mode("append").parquet(path)
    close = packets.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("take_id"), F.lit(-1).cast("long").alias("seq"),
        F.timestamp_micros(F.unix_micros("ts") + closing_seconds * 1_000_000).alias("ts"),
        F.lit(0).cast("long").alias("ch"), F.array().cast("array<double>").alias("v"),
    )
    close.write.mode("append").parquet(path)
    return path
