"""Segmentation of signals: silences, clipped runs, flat tops, quiet windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonolake.functions.levels import amplitude_db, clamp01
from phonolake.operators.intervals import gaps
from phonolake.operators.ordered import SLICE, islands, over_halo, slice_no, with_halo
from phonolake.operators.signal import CLIP_LEVEL, SILENCE_BLOCK
from phonolake.operators.weighting import weighted


def minimum_samples(ms: float, rate: int) -> int:
    return max(1, int(ms / 1000.0 * rate))


def detect_silences(
    blocks: DataFrame, frames: DataFrame, level: str, rate: int, minimum_ms: float,
    thresholds_db: Sequence[float] | Column, size: int = SILENCE_BLOCK,
) -> DataFrame:
    """(rec_id, threshold_db, start, end) for runs of blocks below each threshold.

    Only the settings a block is quiet at are generated, so loud blocks cost nothing. Inner runs end at a block
    border, the last one at the recording's end.
    """
    grid = F.array(*[F.struct(F.lit(float(db)).alias("threshold_db"), F.lit(10 ** (db / 20)).alias("_lin"))
                     for db in thresholds_db])
    quiet = blocks.select("rec_id", "block", F.inline(F.filter(grid, lambda g: F.col(level) < g["_lin"])))
    runs = islands(quiet.drop("_lin"), ["rec_id", "threshold_db"], "block")
    need = minimum_samples(minimum_ms, rate)
    return (
        runs.join(frames, "rec_id")
        .select(
            "rec_id", "threshold_db", (F.col("start") * size).alias("start"),
            F.least((F.col("last") + 1) * size, F.col("frames")).alias("end"),
        )
        .filter(F.col("end") - F.col("start") >= need)
    )


def split_by_silence(silences: DataFrame, frames: DataFrame, rate: int, minimum_seconds: float = 0.1) -> DataFrame:
    """Regions of sound between silences, longer than 0.1 s."""
    timed = silences.select("rec_id", (F.col("start") / rate).alias("start"), (F.col("end") / rate).alias("end"))
    lengths = frames.select("rec_id", (F.col("frames") / rate).alias("duration"))
    return gaps(timed, lengths, ["rec_id"], 0.0).filter(F.col("end") - F.col("start") > minimum_seconds).select(
        "rec_id",
        F.round(F.col("start") * rate).cast("long").alias("start"),
        F.round(F.col("end") * rate).cast("long").alias("end"),
    )


def silence_cuts(silences: DataFrame, rate: int, pad_seconds: float = 0.05, minimum_seconds: float = 0.1) -> DataFrame:
    """What trimming removes: silences shortened by a pad on both sides, only pieces of at least 0.1 s."""
    pad = int(pad_seconds * rate)
    return silences.select(
        "rec_id", (F.col("start") + pad).alias("start"), (F.col("end") - pad).alias("end")
    ).filter(F.col("end") - F.col("start") >= int(minimum_seconds * rate))


def steps(samples: DataFrame) -> DataFrame:
    """First difference and curvature |v − (prev + next)/2|."""
    keys = ["rec_id", "ch"]
    out = over_halo(
        samples, keys, "n",
        {"_p": lambda w: F.lag("v").over(w), "_x": lambda w: F.lead("v").over(w)}, before=1, after=1,
    )
    return out.select(
        *keys, "n", "v", F.abs(F.col("v") - F.col("_p")).alias("step"),
        F.abs(F.col("v") - (F.col("_p") + F.col("_x")) / 2).alias("curvature"),
    )


def local_threshold(values: DataFrame, column: str, rate: int, k: float, floor: float) -> DataFrame:
    """median + k·max(1.4826·MAD, 0.25·median, rms·floor, 2e-7) per 25 ms block with a quarter block of context.

    A block with its context is a few hundred to a few thousand samples, so its percentiles are local; context
    rows are copied to the neighbouring block rather than windowed.
    """
    size = max(4, int(rate * 0.025))
    context = size // 4
    near = with_halo(values, "n", before=context, after=context, size=size).withColumn("_x", F.col(column))
    keys = ["rec_id", "ch", "_slice"]
    middle = near.groupBy(*keys).agg(
        F.percentile("_x", F.lit(0.5)).alias("median"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"),
        F.bool_or("_home").alias("_any"),
    ).filter("_any")
    mad = near.join(middle, keys).groupBy(*keys).agg(
        F.percentile(F.abs(F.col("_x") - F.col("median")), F.lit(0.5)).alias("mad"),
        F.first("median").alias("median"), F.first("rms").alias("rms"),
    )
    spread = F.greatest(1.4826 * F.col("mad"), 0.25 * F.col("median"), F.col("rms") * floor, F.lit(2e-7))
    return mad.select(
        "rec_id", "ch", F.col("_slice").alias("block"), "median", "mad",
        (F.col("median") + k * spread).alias("threshold"),
    )


def clipped_runs(samples: DataFrame, level: float, minimum_run: int = 3, gap: int = 1) -> DataFrame:
    """Same-polarity runs at or above an absolute level, bridging single samples."""
    hot = samples.filter(F.abs("v") >= level).withColumn(
        "polarity", F.when(F.col("v") > 0, 1).otherwise(-1)
    )
    runs = islands(
        hot, ["rec_id", "ch", "polarity"], "n",
        {"hits": ("sum", F.lit(1)), "level": ("max", F.abs("v"))}, gap=gap,
    )
    return runs.select(
        "rec_id", "ch", "polarity", "start", (F.col("last") + 1).alias("end"), "hits", "level"
    ).filter(F.col("end") - F.col("start") >= minimum_run)


def equal_runs(samples: DataFrame, minimum_level: float = 0.1, relative: float = 1e-4) -> DataFrame:
    """Plateaus: runs of adjacent same-sign samples equal within max(2e-7, level·1e-4), at least two long.

    ``slope_in`` and ``slope_out`` are the steps into the first sample and out of the last one (null at the signal's ends).
    """
    keys = ["rec_id", "ch"]
    beside = {"_p": lambda w: F.lag("v").over(w), "_pp": lambda w: F.lag("v", 2).over(w), "_x": lambda w: F.lead("v").over(w)}
    paired = over_halo(samples, keys, "n", beside, before=2, after=1)
    level = F.greatest(F.abs("v"), F.abs("_p"))
    same = (
        (level >= minimum_level)
        & (F.col("v") * F.col("_p") > 0)
        & (F.abs(F.col("v") - F.col("_p")) <= F.greatest(F.lit(2e-7), level * relative))
    )
    pairs = paired.filter(same).withColumn("polarity", F.signum("v").cast("int"))
    runs = islands(
        pairs, [*keys, "polarity"], "n",
        {"level": ("max", level), "inside": ("max", F.abs(F.col("v") - F.col("_p"))),
         "_in": ("min", F.struct("n", F.abs(F.col("_p") - F.col("_pp")).alias("step"))),
         "_out": ("max", F.struct("n", F.abs(F.col("_x") - F.col("v")).alias("step")))},
    )
    return runs.select(
        *keys, "polarity", (F.col("start") - 1).alias("start"), (F.col("last") + 1).alias("end"), "level", "inside",
        F.col("_in.step").alias("slope_in"), F.col("_out.step").alias("slope_out"),
    )


SHOULDER = 5


def run_shoulders(runs: DataFrame, samples: DataFrame, width: int = SHOULDER) -> DataFrame:
    """Figures of a run and the samples beside it, from one equi-join: a run names the positions it needs.

    A run is short (milliseconds), so the positions are exploded and joined on (rec_id, ch, n).
    """
    keyed = runs.withColumn("run_id", F.struct("rec_id", "ch", "polarity", "start"))
    needed = keyed.select(
        "rec_id", "ch", "run_id", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("level").alias("_level"),
        F.explode(F.expr(f"sequence(greatest(0, start - {width}), end - 1 + {width})")).alias("n"),
    )
    paired = over_halo(samples, ["rec_id", "ch"], "n", {"_p": lambda w: F.lag("v").over(w)}, before=1)
    near = needed.join(paired, ["rec_id", "ch", "n"])
    step = F.abs(F.col("v") - F.col("_p"))
    tolerance = F.greatest(F.lit(2e-7), F.col("_level") * 1e-4)
    pair_inside = (F.col("n") > F.col("_s")) & (F.col("n") < F.col("_e"))
    outside = (F.col("n") < F.col("_s")) | (F.col("n") >= F.col("_e"))
    shoulder_pair = (F.col("n") <= F.col("_s")) | (F.col("n") >= F.col("_e"))
    equal = step <= F.greatest(F.lit(1e-8), 0.12 * tolerance)
    return near.groupBy("run_id").agg(
        F.avg(F.when(pair_inside, equal.cast("double"))).alias("equality"),
        F.avg(F.when(pair_inside, step)).alias("inside_step"),
        F.max(F.when(pair_inside, step)).alias("inside_max"),
        F.avg(F.when(shoulder_pair, step)).alias("shoulder_step"),
        F.max(F.when(outside, F.abs("v"))).alias("outside_peak"),
        F.max(F.when(F.col("n") == F.col("_s"), step)).alias("slope_in"),
        F.max(F.when(F.col("n") == F.col("_e"), step)).alias("slope_out"),
    )


def score_clipped(runs: DataFrame, samples: DataFrame, minimum_run: int = 3, threshold: float | None = None,
                  keep: float = 0.65) -> DataFrame:
    """Confidence, severity and estimated peak of clipped runs; ``threshold`` selects the absolute formula."""
    figures = run_shoulders(runs, samples)
    scored = runs.withColumn("run_id", F.struct("rec_id", "ch", "polarity", "start")).join(figures, "run_id")
    size = F.col("end") - F.col("start")
    contrast = clamp01((F.col("shoulder_step") / F.greatest(F.lit(1e-9), F.coalesce("inside_step", F.lit(0.0))) - 1.5) / 6)
    length = clamp01((size - minimum_run + 1) / 6)
    level, tolerance = F.col("level"), F.greatest(F.lit(2e-7), F.col("level") * 1e-4)
    if threshold is None:
        confidence = 0.50 * F.coalesce("equality", F.lit(0.0)) + 0.32 * contrast + 0.18 * F.greatest(length, F.lit(0.35))
        scored = scored.filter(
            (size >= minimum_run)
            & (F.coalesce("outside_peak", F.lit(0.0)) <= level + 1.5 * tolerance)
            & (F.col("equality") > 0)
            & (F.col("inside_max") <= 1.5 * tolerance)
            & ((size >= 6) | (F.col("shoulder_step") >= 0.001 * level))
        )
    else:
        confidence = (
            0.58 + 0.16 * length + 0.14 * contrast + 0.12 * clamp01(8 * (level - threshold) / max(1e-6, threshold))
        )
    overshoot = F.greatest(F.coalesce("slope_in", F.lit(0.0)), F.coalesce("slope_out", F.lit(0.0))) * (size + 2) * 0.20
    return scored.select(
        "rec_id", "ch", "polarity", "start", "end", "level",
        confidence.alias("confidence"),
        clamp01(overshoot / (0.12 * level)).alias("severity"),
        F.greatest(level, level + F.greatest(0.001 * level, overshoot)).alias("estimated_peak"),
    ).filter(F.col("confidence") >= keep)


def flat_tops(samples: DataFrame) -> DataFrame:
    """Plateaus of three or more below digital full scale with a real slope on both sides."""
    runs = equal_runs(samples).filter(
        (F.col("end") - F.col("start") >= 3) & (F.col("level") >= 0.1) & (F.col("level") < CLIP_LEVEL)
    )
    level = F.col("level")
    return runs.filter(
        (F.col("inside") <= 1.5 * F.greatest(F.lit(2e-7), 1e-4 * level))
        & (F.coalesce("slope_in", F.lit(0.0)) >= 0.001 * level)
        & (F.coalesce("slope_out", F.lit(0.0)) >= 0.001 * level)
    ).select("rec_id", "ch", "start", "end", "level")


def repeated_flat_tops(tops: DataFrame, peaks: DataFrame, rate: int, seconds: float = 10.0) -> DataFrame:
    """Recordings with three consistent plateaus (within 1 dB) inside ten seconds, near the overall peak.

    Plateaus are copied to the one next ten-second slice they can reach, so the range window stays local.
    """
    span = int(seconds * rate)
    near = with_halo(tops, "end", before=span, size=span)
    w = Window.partitionBy("rec_id", "ch", "_slice").orderBy("end").rangeBetween(-span, 0)
    strongest = F.max("level").over(w)
    levels = F.collect_list("level").over(w)
    consistent = F.size(F.filter(levels, lambda x: amplitude_db(F.col("_top") / x) <= 1.0))
    checked = near.withColumn("_top", strongest).withColumn("_n", consistent).filter("_home")
    found = checked.join(peaks.select("rec_id", "peak_db"), "rec_id").filter(
        (F.col("_n") >= 3) & (amplitude_db(F.col("_top")) >= F.col("peak_db") - 3.0)
    )
    return peaks.select("rec_id").join(
        found.groupBy("rec_id").agg(F.count(F.lit(1)).alias("alarms")), "rec_id", "left"
    ).select("rec_id", F.coalesce("alarms", F.lit(0)).alias("alarms"), F.col("alarms").isNotNull().alias("flat_tops"))


def zero_crossings(samples: DataFrame, block_frames: int, rate: int, response=None) -> DataFrame:
    """Per block of the high-passed signal, the larger channel count under both rules: both signs non-zero, or only the
    current one."""
    keys = ["rec_id", "ch"]
    s = F.signum("a")
    out = over_halo(weighted(samples, rate, "activity", response=response, out="a").withColumn("_s", s), keys, "n", {"_p": lambda w: F.lag("_s").over(w)}, before=1)
    strict = ((F.col("_s") * F.col("_p")) < 0).cast("long")
    loose = ((F.col("_s") != 0) & (F.col("_s") != F.col("_p"))).cast("long")
    return (
        out.groupBy(*keys, slice_no("n", block_frames).alias("block"))
        .agg(F.sum(F.coalesce(strict, F.lit(0))).alias("a"), F.sum(F.coalesce(loose, F.lit(0))).alias("b"))
        .groupBy("rec_id", "block")
        .agg(F.max("a").alias("both_signed"), F.max("b").alias("current_signed"))
    )


def hop_powers(samples: DataFrame, hop: int) -> DataFrame:
    return samples.groupBy("rec_id", "ch", slice_no("n", hop).alias("hop")).agg(
        F.sum(F.col("v") * F.col("v")).alias("p"), F.count(F.lit(1)).alias("c")
    )


def quietest_window(samples: DataFrame, hop: int, hops: int, minimum_rms: float = 0.0) -> DataFrame:
    """Quietest window of ``hops`` hops per channel that is not silent: (rec_id, ch, start, rms). Ties: earliest."""
    keys = ["rec_id", "ch"]
    windows = over_halo(
        hop_powers(samples, hop), keys, "hop",
        {
            "_sum": lambda w: F.sum("p").over(w.rowsBetween(0, hops - 1)),
            "_n": lambda w: F.sum("c").over(w.rowsBetween(0, hops - 1)),
        },
        after=hops - 1,
    ).filter(F.col("_n") == hop * hops)
    rms = F.sqrt(F.col("_sum") / (hop * hops))
    return windows.withColumn("rms", rms).filter(F.col("rms") > minimum_rms).groupBy(*keys).agg(
        (F.min_by("hop", F.struct("rms", "hop")) * hop).alias("start"), F.min("rms").alias("rms")
    )


def noise_to_programme(samples: DataFrame, hop: int, hops: int) -> DataFrame:
    """Whole RMS over the quietest window in dB per channel; the noisiest channel decides."""
    whole = samples.groupBy("rec_id", "ch").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("whole"))
    quiet = quietest_window(samples, hop, hops)
    return (
        whole.join(quiet, ["rec_id", "ch"])
        .withColumn("db", amplitude_db(F.col("whole") / F.col("rms")))
        .groupBy("rec_id")
        .agg(F.min("db").alias("separation_db"))
    )


def join_events(*tables: DataFrame) -> DataFrame:
    """Union of detector outputs; touching events become one and keep the strongest one's fields.

    Events and their first marks are written once: each running position reads its rows twice, and detectors with their windows
    would otherwise stand in one task with the windows here, several times over.
    """
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    from phonolake.operators.ordered import running
    from phonolake.session import stage

    out = stage(out, "events")
    keys, slices = ["rec_id", "ch"], slice_no("start", SLICE)
    order = ["start", "end", "kind"]
    seen = running(out, keys, slices, order, {"_reach": ("max", F.col("end"))}, inclusive=False)
    flagged = seen.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), 1).otherwise(0))
    numbered = running(stage(flagged, "flagged"), keys, slices, order, {"_island": ("sum", F.col("_new"))})
    best = F.max_by(F.struct("kind", "confidence"), F.struct("confidence", "kind"))
    return (
        numbered.groupBy(*keys, "_island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("_b"), F.count(F.lit(1)).alias("merged"))
        .select(*keys, "start", "end", "_b.kind", "_b.confidence", "merged")
    )


def strongest_event(events: DataFrame) -> DataFrame:
    """One event per recording: highest confidence, ties by channel and position."""
    pick = F.max_by(
        F.struct("ch", "start", "end", "kind", "confidence"),
        F.struct(F.col("confidence"), -F.col("ch"), -F.col("start"), -F.col("end"), F.col("kind")),
    )
    return events.groupBy("rec_id").agg(pick.alias("_b")).select("rec_id", "_b.*")
