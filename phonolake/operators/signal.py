"""Block statistics and waveform pyramid over samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.functions.levels import amplitude_db, is_finite
from phonolake.operators.ordered import slice_no
from phonolake.session import stage

CLIP_LEVEL = 0.999969
SILENCE_BLOCK = 256
BASE_BIN = 64
LEVEL_FACTOR = 4


def file_statistics(samples: DataFrame) -> DataFrame:
    """Per channel peak, RMS, DC, clipped and invalid counts in one partial aggregation."""
    finite = F.when(is_finite(F.col("v")), F.col("v"))
    return samples.groupBy("rec_id", "ch").agg(
        F.max(F.abs(finite)).alias("peak"),
        F.sqrt(F.avg(finite * finite)).alias("rms"),
        (F.avg(finite) * 100).alias("dc_percent"),
        F.count_if(F.abs(finite) >= CLIP_LEVEL).alias("clipped"),
        F.count_if(~is_finite(F.col("v"))).alias("invalid"),
        F.count(F.lit(1)).alias("frames"),
    )


def statistics_by_channel(stats: DataFrame) -> DataFrame:
    """Left and right side by side, levels in dB."""
    wide = stats.groupBy("rec_id").pivot("ch", [0, 1]).agg(
        F.first("peak").alias("peak"), F.first("rms").alias("rms"), F.first("clipped").alias("clipped")
    )
    return wide.select(
        "rec_id",
        *[amplitude_db(F.col(f"{c}_peak")).alias(f"peak_db_{s}") for c, s in ((0, "l"), (1, "r"))],
        *[amplitude_db(F.col(f"{c}_rms")).alias(f"rms_db_{s}") for c, s in ((0, "l"), (1, "r"))],
        (F.coalesce(F.col("0_clipped"), F.lit(0)) + F.coalesce(F.col("1_clipped"), F.lit(0))).alias("clipped"),
    )


def block_peaks(samples: DataFrame, size: int = SILENCE_BLOCK) -> DataFrame:
    return samples.groupBy("rec_id", slice_no("n", size).alias("block")).agg(F.max(F.abs("v")).alias("peak"))


def block_activity(samples: DataFrame, size: int = SILENCE_BLOCK) -> DataFrame:
    """Per block the value at index floor((count-1)*0.75) of the channel maxima: a block is at most ``size`` values."""
    loudest = samples.groupBy("rec_id", slice_no("n", size).alias("block"), "n").agg(F.max(F.abs("v")).alias("a"))
    sorted_values = F.array_sort(F.collect_list("a"))
    pick = F.floor((F.count(F.lit(1)) - 1) * 0.75).cast("int") + 1
    return loudest.groupBy("rec_id", "block").agg(F.element_at(sorted_values, pick).alias("activity"))


def _in_order(order: str, value: Column) -> Column:
    """The values to be averaged in their order, so that a mean is the same in every run; nulls do not count."""
    return F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order), value.alias("x")))))


def _mean(values: str) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, y: a + y["x"]) / F.size(values))


def pyramid_base(samples: DataFrame) -> DataFrame:
    """A bin's squares are summed in the order of its samples."""
    v = F.col("v").cast("double")
    return samples.groupBy("rec_id", "ch", slice_no("n", BASE_BIN).alias("bin")).agg(
        F.min("v").alias("mn"), F.max("v").alias("mx"), _in_order("n", v * v).alias("_s")
    ).select("rec_id", "ch", "bin", "mn", "mx", _mean("_s").alias("ms"), F.lit(0).alias("level"))


def pyramid(samples: DataFrame) -> DataFrame:
    """Levels as rows: each is made of the one below, four bins to one, for recordings that have more than 64 bins there. A mean
    square is the plain mean of the four below it, in their order, so a short last bin counts fully. The base is written
    once; how many levels there are follows from the longest recording, one number.
    """
    base = stage(pyramid_base(samples), "pyramid-base")
    ends = base.groupBy("rec_id", "ch").agg(F.max("bin").alias("_last"))
    last = ends.agg(F.max("_last")).first()[0] or 0
    level, out, number = base.join(ends, ["rec_id", "ch"]), base, 0
    while last + 1 > 64:
        last, number = last >> 2, number + 1
        level = level.filter("_last + 1 > 64").groupBy("rec_id", "ch", F.expr("shiftright(bin, 2)").alias("up"), F.expr("shiftright(_last, 2)").alias("_end")).agg(
            F.min("mn").alias("mn"), F.max("mx").alias("mx"), _in_order("bin", F.col("ms")).alias("_s")
        ).select("rec_id", "ch", F.col("up").alias("bin"), "mn", "mx", _mean("_s").alias("ms"), F.lit(number).alias("level"), F.col("_end").alias("_last"))
        out = out.unionByName(level.drop("_last"))
    return out


def range_summary(samples: DataFrame, levels: DataFrame, ranges: DataFrame) -> DataFrame:
    """min / max / RMS of [s0, s1): coarsest level with at least two bins in it, raw samples below 128.

    A range names the bins it touches (at most about eight times four), so both paths are equi-joins.
    """
    depth = levels.groupBy("rec_id").agg(F.max("level").alias("_deepest"))
    length = F.col("s1") - F.col("s0")
    wanted = F.floor(F.ln((length / (2 * BASE_BIN)).cast("double")) / math.log(LEVEL_FACTOR) + 1e-12)
    level = F.least(F.greatest(wanted, F.lit(0)), F.col("_deepest")).cast("int")
    sized = ranges.join(depth, "rec_id").withColumn("level", level).withColumn(
        "_size", F.lit(BASE_BIN) * F.pow(F.lit(4), F.col("level")).cast("long")
    )
    spread = sized.filter(length >= 2 * BASE_BIN).withColumn(
        "bin", F.explode(F.expr("sequence(s0 div _size, (s1 - 1) div _size)"))
    )
    coarse = spread.join(levels, ["rec_id", "level", "bin"]).groupBy("rec_id", "ch", "s0", "s1").agg(
        F.min("mn").alias("mn"), F.max("mx").alias("mx"), F.sqrt(F.avg("ms")).alias("rms")
    )
    raw_ranges = ranges.filter((length < 2 * BASE_BIN) & (length > 0)).withColumn(
        "n", F.explode(F.expr("sequence(s0, s1 - 1)"))
    )
    raw = samples.join(raw_ranges, ["rec_id", "n"]).groupBy("rec_id", "ch", "s0", "s1").agg(
        F.min("v").alias("mn"), F.max("v").alias("mx"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms")
    )
    return coarse.unionByName(raw)
