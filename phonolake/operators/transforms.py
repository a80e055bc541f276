"""Sample-wise transforms over ``samples(rec_id, ch, n, v)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonolake.functions.levels import clamp, db_gain, is_finite
from phonolake.operators.ordered import SLICE, running, slice_no

KEYS = ["rec_id"]


def gain(samples: DataFrame, gains: DataFrame) -> DataFrame:
    """v·10^(gain_db/20); rows whose result is not finite are left out (see ``gain_rejects``)."""
    scaled = samples.join(gains.select("rec_id", "gain_db"), "rec_id").withColumn(
        "v", F.col("v") * db_gain(F.col("gain_db"))
    )
    return scaled.filter(is_finite(F.col("v"))).drop("gain_db")


def gain_report(samples: DataFrame, gains: DataFrame) -> DataFrame:
    """Peak after the gain and number of samples that left the finite range. One partial aggregation, then the gain."""
    peaks = samples.groupBy("rec_id").agg(
        F.max(F.abs("v")).alias("_peak"), F.count_if(~is_finite(F.col("v"))).alias("rejected")
    )
    return peaks.join(gains.select("rec_id", "gain_db"), "rec_id").select(
        "rec_id", (F.col("_peak") * db_gain(F.col("gain_db"))).alias("peak"), "rejected"
    )


def peak_normalize(samples: DataFrame, target_dbfs: float) -> DataFrame:
    """Scale each recording to a peak; silent recordings pass unchanged and are flagged."""
    peaks = samples.groupBy(*KEYS).agg(F.max(F.abs("v")).alias("_peak"))
    level = 10 ** (target_dbfs / 20)
    return samples.join(peaks, KEYS).select(
        *samples.columns[:-1],
        F.when(F.col("_peak") > 0, F.col("v") * (F.lit(level) / F.col("_peak"))).otherwise(F.col("v")).alias("v"),
        (F.col("_peak") <= 0).alias("silent"),
    )


def remove_dc(samples: DataFrame) -> DataFrame:
    means = samples.groupBy("rec_id", "ch").agg(F.avg("v").alias("_mean"))
    return samples.join(means, ["rec_id", "ch"]).select(
        "rec_id", "ch", "n", (F.col("v") - F.col("_mean")).alias("v")
    )


def sanitize(samples: DataFrame) -> DataFrame:
    return samples.withColumn("v", F.when(is_finite(F.col("v")), F.col("v")).otherwise(0.0))


def invalid_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("rec_id", "ch").agg(
        F.count_if(~is_finite(F.col("v"))).alias("invalid"), F.count(F.lit(1)).alias("samples")
    )


def swap_channels(samples: DataFrame) -> DataFrame:
    return samples.withColumn("ch", F.when(F.col("ch") < 2, 1 - F.col("ch")).otherwise(F.col("ch")))


def invert(samples: DataFrame, channel: int = -1) -> DataFrame:
    """Flip the sign of one channel, or of all of them for -1."""
    flipped = -F.col("v")
    if channel >= 0:
        flipped = F.when(F.col("ch") == channel, flipped).otherwise(F.col("v"))
    return samples.withColumn("v", flipped)


def balance(samples: DataFrame, left_db: float, right_db: float) -> DataFrame:
    trim = F.when(F.col("ch") == 0, 10 ** (left_db / 20)).when(F.col("ch") == 1, 10 ** (right_db / 20))
    return samples.withColumn("v", F.col("v") * trim.otherwise(1.0))


def mono_mixdown(samples: DataFrame) -> DataFrame:
    return (
        samples.groupBy("rec_id", "n")
        .agg((F.sum("v") / F.count(F.lit(1))).alias("v"))
        .select("rec_id", F.lit(0).cast("long").alias("ch"), "n", "v")
    )


def mono_to_stereo(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("ch") == 0).withColumn(
        "ch", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    ).select("rec_id", "ch", "n", "v")


def extract_channel(samples: DataFrame, channel: int) -> DataFrame:
    return samples.filter(F.col("ch") == channel).withColumn("ch", F.lit(0).cast("long"))


def stereo_pairs(samples: DataFrame) -> DataFrame:
    """(l, r) per position by conditional aggregation, no self join."""
    return samples.groupBy("rec_id", "n").agg(
        F.max(F.when(F.col("ch") == 0, F.col("v"))).alias("l"),
        F.max(F.when(F.col("ch") == 1, F.col("v"))).alias("r"),
    )


def mid_side(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "rec_id", "n", ((F.col("l") + F.col("r")) * 0.5).alias("mid"), ((F.col("l") - F.col("r")) * 0.5).alias("side")
    )


def side_scale(pairs: DataFrame, level: float) -> DataFrame:
    """Narrow the image to ``level``; 1 or more changes nothing."""
    if level >= 1:
        return pairs.select("rec_id", "n", "l", "r")
    ms = mid_side(pairs)
    side = F.col("side") * max(0.0, level)
    return ms.select("rec_id", "n", (F.col("mid") + side).alias("l"), (F.col("mid") - side).alias("r"))


def reverse_range(samples: DataFrame, start: Column, end: Column) -> DataFrame:
    inside = (F.col("n") >= start) & (F.col("n") < end)
    return samples.withColumn("n", F.when(inside, start + end - 1 - F.col("n")).otherwise(F.col("n")))


def frames_per_recording(samples: DataFrame) -> DataFrame:
    return samples.groupBy("rec_id").agg((F.max("n") + 1).alias("frames"))


def apply_envelope(samples: DataFrame, gain_of) -> DataFrame:
    """Multiply by ``gain_of(i, frames)`` over the whole recording."""
    return samples.join(frames_per_recording(samples), "rec_id").select(
        "rec_id", "ch", "n", (F.col("v") * gain_of(F.col("n"), F.col("frames"))).alias("v")
    )


def delete_ranges(samples: DataFrame, ranges: DataFrame, width: int = SLICE) -> DataFrame:
    """Remove [start, end) ranges (disjoint per recording); later samples move forward.

    The shift of a range boundary is a running sum over ranges. Each sample takes the shift of the last range
    starting at or before it: per slice the ranges that begin inside it, plus one carried row.
    """
    edits = running(
        ranges.select("rec_id", "start", "end"),
        KEYS,
        slice_no("start", width),
        ["start"],
        {"_cut": ("sum", F.col("end") - F.col("start"))},
    ).select("rec_id", F.col("start").alias("n"), F.col("end").alias("_until"), "_cut")
    return _shifted(samples, edits, width, keep_inside=False)


def insert_silence(samples: DataFrame, inserts: DataFrame, width: int = SLICE) -> DataFrame:
    """Insert ``length`` zero samples before position ``start`` on every channel; later samples move back."""
    grown = running(
        inserts.select("rec_id", "start", "length"),
        KEYS,
        slice_no("start", width),
        ["start"],
        {"_moved": ("sum", F.col("length"))},
    )
    edits = grown.select(
        "rec_id", F.col("start").alias("n"), F.col("start").alias("_until"), (-F.col("_moved")).alias("_cut")
    )
    kept = _shifted(samples, edits, width, keep_inside=True)
    channels = samples.select("rec_id", "ch").distinct()
    first = F.col("start") + F.col("_moved") - F.col("length")
    zeros = (
        grown.filter("length > 0")
        .select("rec_id", first.alias("_from"), "length")
        .join(channels, "rec_id")
        .select("rec_id", "ch", F.explode(F.expr("sequence(_from, _from + length - 1)")).alias("n"))
        .withColumn("v", F.lit(0.0))
    )
    return kept.unionByName(zeros)


def _shifted(samples: DataFrame, edits: DataFrame, width: int, keep_inside: bool) -> DataFrame:
    edit = F.struct(F.col("_until"), F.col("_cut"))
    both = samples.select("rec_id", "ch", "n", "v", F.lit(None).cast(edits.select(edit).schema[0].dataType).alias("_e"))
    channels = samples.select("rec_id", "ch").distinct()
    marks = edits.join(channels, "rec_id").select(
        "rec_id", "ch", "n", F.lit(None).cast("double").alias("v"), edit.alias("_e")
    )
    merged = both.unionByName(marks).withColumn("_kind", F.when(F.col("_e").isNull(), 1).otherwise(0))
    seen = running(
        merged, ["rec_id", "ch"], slice_no("n", width), ["n", "_kind"], {"_last": ("last", F.col("_e"))}
    ).filter("_kind = 1")
    if not keep_inside:
        seen = seen.filter(F.col("_last").isNull() | (F.col("n") >= F.col("_last._until")))
    return seen.select(
        "rec_id", "ch", (F.col("n") - F.coalesce(F.col("_last._cut"), F.lit(0))).alias("n"), "v"
    )


def keep_range(samples: DataFrame, ranges: DataFrame) -> DataFrame:
    """Trim each recording to one [start, end) range, starting again at 0."""
    r = ranges.select("rec_id", F.col("start").alias("_from"), F.col("end").alias("_to"))
    return (
        samples.join(r, "rec_id")
        .filter((F.col("n") >= F.col("_from")) & (F.col("n") < F.col("_to")))
        .select("rec_id", "ch", (F.col("n") - F.col("_from")).alias("n"), "v")
    )


def mix(dry: DataFrame, processed: DataFrame, wet: float) -> DataFrame:
    wet = min(1.0, max(0.0, wet))
    p = processed.select("rec_id", "ch", "n", F.col("v").alias("_p"))
    return dry.join(p, ["rec_id", "ch", "n"]).select(
        "rec_id", "ch", "n", (F.col("v") * (1 - wet) + F.col("_p") * wet).alias("v")
    )


def residual(dry: DataFrame, processed: DataFrame) -> DataFrame:
    p = processed.select("rec_id", "ch", "n", F.col("v").alias("_p"))
    return dry.join(p, ["rec_id", "ch", "n"]).select("rec_id", "ch", "n", (F.col("v") - F.col("_p")).alias("v"))


def signal_levels(samples: DataFrame) -> DataFrame:
    return samples.groupBy("rec_id").agg(
        F.max(F.abs("v")).alias("peak"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms")
    )


def quantise(samples: DataFrame, bits: int = 16) -> DataFrame:
    """Round to the integer grid (half even), clamped to the code range; adds the code."""
    full = float(2 ** (bits - 1))
    code = clamp(F.bround(F.col("v") * full, 0), -full, full - 1)
    return samples.select("rec_id", "ch", "n", code.cast("long").alias("code"), (code / full).alias("v"))


def exact_16_bit(samples: DataFrame) -> DataFrame:
    """True where every sample already lies on the 16-bit grid."""
    scaled = F.col("v") * 32768.0
    on_grid = is_finite(F.col("v")) & (scaled >= -32768) & (scaled <= 32767) & (scaled == F.floor(scaled))
    return samples.groupBy("rec_id").agg(F.bool_and(on_grid).alias("exact_16_bit"))


def mono_choice(pairs: DataFrame) -> DataFrame:
    """Per recording: the average of both channels, or the stronger one when averaging cancels it."""
    l, r = F.col("l"), F.col("r")
    m = (l + r) * 0.5
    energy = pairs.groupBy("rec_id").agg(
        F.sum(l * l).alias("energy_l"), F.sum(r * r).alias("energy_r"), F.sum(m * m).alias("energy_mix")
    )
    strongest = F.greatest("energy_l", "energy_r")
    return energy.select(
        "rec_id",
        F.when(F.col("energy_mix") >= 0.25 * strongest, "mix")
        .when(F.col("energy_l") >= F.col("energy_r"), "left")
        .otherwise("right")
        .alias("source"),
    )


def to_mono(pairs: DataFrame) -> DataFrame:
    return pairs.join(mono_choice(pairs), "rec_id").select(
        "rec_id",
        "n",
        F.when(F.col("source") == "mix", (F.col("l") + F.col("r")) * 0.5)
        .when(F.col("source") == "left", F.col("l"))
        .otherwise(F.col("r"))
        .alias("v"),
        "source",
    )


def recognition_gain(samples: DataFrame) -> DataFrame:
    """Bounded gain for a recogniser's copy: quiet material up by at most 20, loud material down to 0.98."""
    p = F.col("peak")
    return samples.groupBy("rec_id").agg(F.max(F.abs("v")).alias("peak")).select(
        "rec_id",
        "peak",
        F.when(p <= 1e-8, 1.0)
        .when(p < 0.15, F.least(F.lit(20.0), 0.8 / p))
        .otherwise(F.least(F.lit(1.0), 0.98 / p))
        .alias("gain"),
    )
