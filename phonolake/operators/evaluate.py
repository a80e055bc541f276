"""Corpus evaluation: scorecards, damage planting, screening and scoring of methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.functions.levels import clamp, is_finite
from phonolake.operators.ordered import slice_no
from phonolake.operators.quantiles import exact_quantiles


def scorecard(cells: DataFrame) -> DataFrame:
    """Cells, mean, worst, losses and recall per corpus, per severity and over all, from one grouping-sets pass."""
    recall = F.when(F.col("planted") > 0, F.least(F.lit(1.0), F.col("found") / F.col("planted")))
    view = cells.withColumn("_recall", recall)
    return view.groupingSets([["corpus"], ["severity"], []], "corpus", "severity").agg(
        F.count(F.lit(1)).alias("cells"),
        F.avg("gain").alias("mean_gain"),
        F.min("gain").alias("worst_gain"),
        F.count_if(F.col("gain") < 0).alias("below_nothing"),
        F.avg("_recall").alias("recall"),
    ).withColumns({"corpus": F.coalesce("corpus", F.lit("ALL")), "severity": F.coalesce("severity", F.lit(-1))})


def false_event_rates(rates: DataFrame) -> DataFrame:
    """Median and largest false events per second by corpus; ``rates(corpus, recording, per_second)``."""
    median = exact_quantiles(rates, ["corpus"], "per_second", {"median_rate": ("linear", 0.5)})
    return median.join(rates.groupBy("corpus").agg(F.max("per_second").alias("max_rate")), "corpus")


def population_profile(recordings: DataFrame) -> DataFrame:
    """Crest factor min / median / max, share already clipped, mean plateau per corpus."""
    median = exact_quantiles(recordings, ["corpus"], "crest_db", {"crest_median": ("linear", 0.5)})
    rest = recordings.groupBy("corpus").agg(
        F.min("crest_db").alias("crest_min"), F.max("crest_db").alias("crest_max"),
        F.avg((F.col("clipped") > 0).cast("double")).alias("clipped_share"), F.avg("plateau").alias("mean_plateau"),
    )
    return rest.join(median, "corpus")


def worst_cells(cells: DataFrame, count: int) -> DataFrame:
    """The ``count`` worst cells; a report's length is the feature."""
    return cells.orderBy("gain", *[c for c in cells.columns if c != "gain"]).limit(count)


def programme_peak(samples: DataFrame, robust: bool) -> DataFrame:
    """Largest magnitude, or for click-laden material the one at sorted index int(0.9995·N)."""
    magnitudes = samples.select("rec_id", F.abs("v").alias("a"))
    if not robust:
        return magnitudes.groupBy("rec_id").agg(F.max("a").alias("peak"))
    return exact_quantiles(magnitudes, ["rec_id"], "a", {"peak": ("index", 0.9995)})


def plant_clipping(samples: DataFrame, peaks: DataFrame, fractions: list[float]) -> DataFrame:
    """Clip at a fraction of the programme peak and rescale to the rail; ``damaged`` marks altered samples."""
    severities = F.array(*[F.lit(float(f)) for f in fractions])
    level = F.col("peak") * F.col("severity")
    return samples.join(peaks, "rec_id").withColumn("severity", F.explode(severities)).select(
        "rec_id", "severity", "ch", "n", (F.col("v") / level).alias("clean"),
        clamp(F.col("v") / level, -1.0, 1.0).alias("v"), (F.abs("v") > level).alias("damaged"),
    )


def plant_gaps(samples: DataFrame, gaps: DataFrame) -> DataFrame:
    """Zero the samples inside planted gaps; a gap names its positions, so this is an equi-join."""
    inside = gaps.withColumn("n", F.explode(F.expr("sequence(start, end - 1)"))).select(
        "rec_id", "n", F.lit(True).alias("_gap")
    ).distinct()
    return samples.join(inside, ["rec_id", "n"], "left").select(
        "rec_id", "ch", "n", F.when(F.col("_gap"), 0.0).otherwise(F.col("v")).alias("v"),
        F.coalesce("_gap", F.lit(False)).alias("damaged"),
    )


def snr(clean: Column, candidate: Column, mask: Column) -> Column:
    """10·log10 of clean power over error power on the masked samples; the error counts as at least 1e-30."""
    signal = F.sum(F.when(mask, clean * clean))
    error = F.sum(F.when(mask, (clean - candidate) * (clean - candidate)))
    return 10 * F.log10(signal / F.greatest(error, F.lit(1e-30)))


def damaged_snr(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(
        F.count_if("damaged").alias("damaged"), snr(F.col("clean"), F.col("v"), F.col("damaged")).alias("snr_db")
    )


def segmental_snr(cells: DataFrame, keys: list[str], segment: int) -> DataFrame:
    """Mean over 20 ms segments of the SNR clamped to −10…35 dB; segments without signal are left out."""
    clean, v = F.col("clean"), F.col("v")
    parts = cells.groupBy(*keys, "ch", slice_no("n", segment).alias("seg")).agg(
        F.sum(clean * clean).alias("s"), F.sum((clean - v) * (clean - v)).alias("e"),
        F.count(F.lit(1)).alias("_n"),
    ).filter((F.col("s") > 0) & (F.col("_n") == segment))
    db = clamp(10 * F.log10(F.col("s") / F.greatest(F.col("e"), F.lit(1e-30))), -10.0, 35.0)
    return parts.groupBy(*keys).agg(F.avg(db).alias("segmental_db"))


Method = Callable[[DataFrame], DataFrame]


def evaluate(cells: DataFrame, methods: dict[str, Method]) -> DataFrame:
    """Run every method over all (recording, severity) cells and compare with doing nothing.

    A method maps the cell table to a table with the same columns and repaired ``v``; it sees all cells at once, so
    Spark, not this function, decides how they are spread.
    """
    keys = ["rec_id", "severity"]
    nothing = damaged_snr(cells, keys).select(*keys, F.col("snr_db").alias("raw_db"), "damaged")
    out = None
    for name, method in methods.items():
        scored = damaged_snr(method(cells), keys).select(*keys, F.lit(name).alias("method"), F.col("snr_db").alias("score_db"))
        out = scored if out is None else out.unionByName(scored)
    return out.join(nothing, keys).withColumn("gain", F.col("score_db") - F.col("raw_db"))


def screen_references(samples: DataFrame, runs: DataFrame, minimum_frames: int, tolerated_share: float) -> DataFrame:
    """(rec_id, reason): recordings unfit as clean references; NULL reason means usable."""
    frames = samples.groupBy("rec_id").agg(
        (F.max("n") + 1).alias("frames"), F.count(F.lit(1)).alias("samples"),
        F.count_if(~is_finite(F.col("v"))).alias("bad"), F.max(F.abs("v")).alias("peak"),
    )
    clipped = runs.groupBy("rec_id").agg(F.sum(F.col("end") - F.col("start")).alias("clipped"))
    share = F.coalesce("clipped", F.lit(0)) / F.col("samples")
    return frames.join(clipped, "rec_id", "left").select(
        "rec_id",
        F.when(F.col("frames") < minimum_frames, "too short")
        .when(F.col("bad") > 0, "non-finite samples")
        .when(F.col("peak") <= 1e-6, "silent")
        .when(share > tolerated_share, "already clipped")
        .alias("reason"),
        share.alias("clipped_share"),
    )


def tolerated_fraction(run: Column) -> Column:
    """Clipped fraction below which the sparse solver pays off, a parabola in the logarithm of the mean run."""
    l = F.ln(F.greatest(run, F.lit(1.5)))
    return F.when(is_finite(run), clamp(-0.50 + 1.10 * l - 0.22 * l * l, 0.0, 1.0)).otherwise(0.0)


def declip_routing(runs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Clipped fraction and mean run per channel against the tolerated curve."""
    size = F.col("end") - F.col("start")
    per = runs.groupBy("rec_id", "ch").agg(F.sum(size).alias("clipped"), F.avg(size).alias("mean_run"))
    return lengths.join(per, ["rec_id", "ch"], "left").select(
        "rec_id", "ch", (F.coalesce("clipped", F.lit(0)) / F.col("frames")).alias("fraction"),
        F.coalesce("mean_run", F.lit(0.0)).alias("mean_run"),
    ).withColumn(
        "method",
        F.when(F.col("fraction") <= 0, "none")
        .when(F.col("fraction") < tolerated_fraction(F.col("mean_run")), "sparse")
        .otherwise("peak"),
    )


def event_rates(events: DataFrame, lengths: DataFrame, rate: int) -> DataFrame:
    """Events per minute, accepted share and mean confidence by kind."""
    per = events.groupBy("rec_id", "kind").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("confidence") >= 0.65).alias("accepted"),
        F.avg("confidence").alias("mean_confidence"),
    )
    return per.join(lengths, "rec_id").select(
        "rec_id", "kind", "candidates", "accepted", "mean_confidence",
        (F.col("accepted") / (F.col("frames") / rate / 60)).alias("per_minute"),
    )


def treatment(clicks: DataFrame, clips: DataFrame, side: DataFrame, lengths: DataFrame, rate: int) -> DataFrame:
    """Settings per recording from event tables and the side/mid level.

    ``clicks(rec_id, confidence)``, ``clips(rec_id, level, estimated_peak, severity)``, ``side(rec_id, side_to_mid_db)``.
    """
    def step(value, size):
        return F.floor(value / size + 0.5) * size

    c = clicks.groupBy("rec_id").agg(F.count(F.lit(1)).alias("_clicks"), F.avg("confidence").alias("_confidence"))
    headroom = 20 * F.log10(F.greatest(F.greatest(F.lit(1e-9), F.col("level")), F.abs("estimated_peak")) / F.greatest(F.lit(1e-9), F.col("level")))
    p = clips.groupBy("rec_id").agg(
        F.count(F.lit(1)).alias("_clips"), F.avg("severity").alias("_severity"), F.max(headroom).alias("_headroom")
    )
    all_ = lengths.join(c, "rec_id", "left").join(p, "rec_id", "left").join(side, "rec_id", "left")
    per_minute = F.col("_clicks") / F.greatest(F.lit(1 / 60.0), F.col("frames") / rate / 60.0)
    x = (F.col("side_to_mid_db") + 14.0) / 6.0
    width = step(clamp(0.20 + 0.80 / (1 + F.exp(-5.0 * (x - 0.55))), 0.20, 1.0), 0.05)
    return all_.select(
        "rec_id",
        F.col("_clicks").isNotNull().alias("repair_clicks"),
        F.when((per_minute > 120) & (F.col("_confidence") < 0.68), 6.5).otherwise(7.0).alias("click_sensitivity"),
        F.when(F.col("_clicks").isNull(), 0.65).otherwise(1.0).alias("click_strength"),
        F.col("_clips").isNotNull().alias("repair_clips"),
        F.when(F.col("_clips").isNull(), 0.65)
        .otherwise(step(clamp(0.58 + F.col("_severity") * 0.34, 0.60, 0.95), 0.05)).alias("declip_strength"),
        step(clamp(F.coalesce("_headroom", F.lit(4.0)) + 0.5, 1.0, 12.0), 0.5).alias("declip_headroom_db"),
        F.when(-20 * F.log10(F.greatest(width, F.lit(1e-6))) < 3.0, 1.0).otherwise(width).alias("side_level"),
    )


def crackle_decision(counts: DataFrame, rate: int) -> DataFrame:
    """counts(rec_id, events, rejected, frames): dense and mostly accepted candidates are crackle."""
    candidates = F.col("events") + F.col("rejected")
    density = F.col("events") * rate / F.col("frames")
    share = F.when(candidates > 0, F.col("events") / candidates).otherwise(0.0)
    return counts.select(
        "rec_id", candidates.alias("candidates"), density.alias("density"), share.alias("acceptance"),
        ((F.col("events") >= 3) & (density >= 0.25) & (share >= 0.20)).alias("decrackle"),
    )
