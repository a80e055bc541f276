"""The 100 ms block record and everything decided from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonolake.functions.levels import amplitude_db, clamp, floor_half_db, is_finite, power_db
from phonolake.operators.ordered import SLICE, halo_window, running, slice_no, with_halo
from phonolake.operators.quantiles import exact_quantiles, quantiles_of
from phonolake.operators.signal import CLIP_LEVEL
from phonolake.operators.weighting import filtered, weighted, weighting_response

PROGRAM_BLOCK_DB = -55.0
PROGRAM_PEAK_DB = -35.0
SEPARATION_DB = 10.0
HISTOGRAM_BINS = 128
DB_PER_BIN = 0.5
TRIMMED_FRACTION = 0.005
CLICK_NARROWNESS_DB = 6.0
HUM_QUIET_FLOOR_DB = -90.0
HUM_MINIMUM_DB = -80.0
HUM_DOMINANCE_DB = -3.0
HUM_QUIET_BLOCKS = 10
INTERSAMPLE_PREMIUM_DB = 3.0
MINIMUM_ACTIVE_SECONDS = 10.0
PEAK_RISE_DB = 3.0
NOVELTY_HALF_LIFE_DB = 6.0


def _trimmed(block: np.ndarray, v: np.ndarray, blocks: int) -> np.ndarray:
    """Trimmed peak of blocks 0 to ``blocks``, NaN where nothing is loud enough to count."""
    magnitude = np.abs(v)
    heard = magnitude > 1e-9
    bins = np.clip(np.floor(-20 * np.log10(magnitude[heard]) / DB_PER_BIN), 0, HISTOGRAM_BINS - 1).astype(np.int64)
    counts = np.bincount(block[heard] * HISTOGRAM_BINS + bins, minlength=blocks * HISTOGRAM_BINS)
    upto = np.cumsum(counts.reshape(blocks, HISTOGRAM_BINS), axis=1)
    enough = upto >= np.maximum(1, np.floor(np.bincount(block, minlength=blocks) * TRIMMED_FRACTION))[:, None]
    return np.where(enough.any(axis=1), -(enough.argmax(axis=1) + 0.5) * DB_PER_BIN, np.nan)


def trimmed_peak(samples: DataFrame, block_frames: int) -> DataFrame:
    """First half-dB histogram bin, loudest first, whose cumulative count reaches 0.5 % of the block."""
    span = max(1, SLICE // block_frames)

    def trim(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["_slice"].iloc[0]) * span
        found = _trimmed(pdf["n"].to_numpy(np.int64) // block_frames - first, pdf["v"].to_numpy(float), span)
        at = np.flatnonzero(~np.isnan(found))
        return pd.DataFrame({"rec_id": pdf["rec_id"].iloc[0], "block": at + first, "trimmed_peak_db": found[at]})

    return samples.select("rec_id", "n", "v", slice_no("n", span * block_frames).alias("_slice")).groupBy("rec_id", "_slice").applyInPandas(
        trim, "rec_id long, block long, trimmed_peak_db double")


def active(samples: DataFrame, rate: int, response=None) -> DataFrame:
    """samples with ``a``: the signal after the 150 Hz high-pass, where rumble and hum no longer count as activity."""
    return weighted(samples, rate, "activity", response=response, out="a")


def block_summary(samples: DataFrame, rate: int, response=None) -> DataFrame:
    """Thirteen figures per 100 ms block; activity and crossings are of the high-passed signal (``active``).

    Zero crossings compare with the previous sample of the same channel, also across a block border. Slices of whole blocks
    are filtered and summed on their own, all channels together, with a halo as long as the response. NaN counts as missing.
    """
    frames = rate // 10
    taps = np.asarray(response if response is not None else weighting_response("activity", rate), dtype=float)
    span = -(-max(SLICE, len(taps)) // frames)

    def channel(ch, part: pd.DataFrame, first: int) -> pd.DataFrame:
        v, n, home = part["v"].to_numpy(float), part["n"].to_numpy(np.int64), part["_home"].to_numpy(bool)
        a = filtered(np.nan_to_num(v, nan=0.0, posinf=0.0, neginf=0.0), taps)
        sign = np.sign(a)
        before = np.concatenate([[np.nan], sign[:-1]])[home]
        v, n, a, sign = v[home], n[home], a[home], sign[home]
        block = n // frames - first
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        there = ~np.isnan(v)
        x, known = np.where(there, v, 0.0), np.add.reduceat(there, starts, dtype=np.int64) > 0
        total = lambda y: np.where(known, np.add.reduceat(y, starts), np.nan)
        theta = lambda hz: 2 * 3.141592653589793 * hz * n / rate
        compared = np.add.reduceat(~np.isnan(before), starts, dtype=np.int64) > 0
        crossings = np.add.reduceat(sign * before < 0, starts, dtype=np.int64)
        return pd.DataFrame({
            "ch": ch, "block": block[starts], "frames": np.diff(np.append(starts, len(n))), "power": total(x * x),
            "activity": np.add.reduceat(a * a, starts), "peak": np.where(known, np.maximum.reduceat(np.abs(x), starts), np.nan),
            "zc": np.where(compared, crossings, np.nan), "total": total(x),
            "clipped": np.add.reduceat(np.abs(x) >= CLIP_LEVEL, starts, dtype=np.int64),
            **{f"{name}{hz}": total(x * f(theta(hz))) for hz in (50, 60) for name, f in (("c", np.cos), ("s", np.sin))}})

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["_slice"].iloc[0]) * span
        own = pdf[pdf["_home"]]
        if own.empty:
            return pd.DataFrame(columns=names)
        trimmed = _trimmed(own["n"].to_numpy(np.int64) // frames - first, own["v"].to_numpy(float), span)
        parts = [channel(ch, part, first) for ch, part in pdf.sort_values(["ch", "n"]).groupby("ch", dropna=False) if part["_home"].any()]
        out = pd.concat(parts, ignore_index=True)
        return out.assign(rec_id=pdf["rec_id"].iloc[0], trimmed=trimmed[out["block"]], block=out["block"] + first)[names]

    types = {"rec_id": "long", "ch": "long", "block": "long", "frames": "long", "clipped": "long"}
    names = ["rec_id", "ch", "block", "frames", "power", "activity", "peak", "zc", "total", "clipped", "c50", "s50", "c60", "s60", "trimmed"]
    haloed = with_halo(samples.select("rec_id", "ch", "n", "v"), "n", before=len(taps), size=span * frames)
    per_channel = haloed.groupBy("rec_id", "_slice").applyInPandas(summed, ", ".join(f"{c} {types.get(c, 'double')}" for c in names))
    per_channel = per_channel.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in names if c not in types})
    left, right = F.col("ch") == 0, F.col("ch") == 1
    n = F.max("frames")
    channels = F.count(F.lit(1))

    def hum(hz):
        # The resonator runs on the channel mean; sums over channels divided by their number give the same.
        c, s = F.sum(f"c{hz}") / channels, F.sum(f"s{hz}") / channels
        return power_db(2 * (c * c + s * s) / (n * n))

    def side(condition, name):
        return F.max(F.when(condition, F.col(name)))

    return per_channel.groupBy("rec_id", "block").agg(
        n.alias("frames"),
        channels.alias("channels"),
        power_db(F.sum("power") / (n * channels)).alias("rms_db"),
        power_db(F.sum("activity") / (n * channels)).alias("activity_rms_db"),
        amplitude_db(F.max("peak")).alias("peak_db"),
        hum(50).alias("hum50_db"),
        hum(60).alias("hum60_db"),
        (F.max("zc") * rate / n).alias("zc_per_s"),
        (side(left, "power") / n).alias("left_ms"),
        (F.coalesce(side(right, "power"), side(left, "power")) / n).alias("right_ms"),
        (side(left, "total") / n).alias("left_mean"),
        (F.coalesce(side(right, "total"), side(left, "total")) / n).alias("right_mean"),
        F.sum("clipped").alias("clipped"),
        F.coalesce(F.max("trimmed"), F.lit(float("-inf"))).alias("trimmed_peak_db"),
    )


def is_program(threshold: Column, rate: int, minimum_peak: float = PROGRAM_PEAK_DB) -> Column:
    """Loud enough, not a lone click, and neither rumble nor hiss."""
    return (
        (F.col("activity_rms_db") > threshold)
        & (F.col("peak_db") > minimum_peak)
        & (F.col("zc_per_s") >= 150)
        & (F.col("zc_per_s") <= rate * 0.40)
    )


def robust_peak() -> Column:
    narrow = is_finite(F.col("trimmed_peak_db")) & is_finite(F.col("peak_db")) & (
        F.col("peak_db") - F.col("trimmed_peak_db") > CLICK_NARROWNESS_DB
    )
    return F.when(narrow, F.col("trimmed_peak_db")).otherwise(F.col("peak_db"))


def floor_figures(blocks: DataFrame) -> DataFrame:
    """p10 / p50 / p90 of activity, the learned floor (null if inseparable) and the activity threshold."""
    q = exact_quantiles(
        blocks, ["rec_id"], "activity_rms_db", {p: ("linear", x) for p, x in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))}
    )
    separable = F.col("p90") - F.col("p10") >= SEPARATION_DB
    return q.select(
        "*",
        F.when(separable, F.col("p10")).alias("noise_floor_db"),
        F.when(separable, F.greatest(F.lit(PROGRAM_BLOCK_DB), F.col("p10") + SEPARATION_DB))
        .when(F.col("p50") > PROGRAM_BLOCK_DB, F.lit(PROGRAM_BLOCK_DB))
        .alias("threshold_db"),
    )


def classify(blocks: DataFrame, rate: int, floors: DataFrame | None = None) -> DataFrame:
    """Adds ``class``: active, quiet (finite and above the hum floor) or none."""
    floors = floors if floors is not None else floor_figures(blocks)
    quiet = is_finite(F.col("rms_db")) & (F.col("rms_db") > HUM_QUIET_FLOOR_DB)
    return blocks.join(floors.select("rec_id", "threshold_db", "noise_floor_db"), "rec_id").withColumn(
        "class",
        F.when(F.col("threshold_db").isNull(), "none")
        .when(is_program(F.col("threshold_db"), rate), "active")
        .when(quiet, "quiet")
        .otherwise("none"),
    )


def channel_balance(classified: DataFrame) -> DataFrame:
    """Left/right power of the active blocks in dB (±60) and the worse channel's mean DC."""
    l, r = F.col("_l"), F.col("_r")
    return (
        classified.filter("class = 'active'")
        .groupBy("rec_id")
        .agg(
            F.sum("left_ms").alias("_l"), F.sum("right_ms").alias("_r"),
            F.greatest(F.abs(F.avg("left_mean")), F.abs(F.avg("right_mean"))).alias("_dc"),
            F.max("channels").alias("_ch"),
        )
        .select(
            "rec_id",
            F.when((F.col("_ch") < 2) | ((l <= 0) & (r <= 0)), 0.0)
            .when(r <= 0, 60.0)
            .when(l <= 0, -60.0)
            .otherwise(clamp(10 * F.log10(l / r), -60.0, 60.0))
            .alias("balance_db"),
            amplitude_db(F.col("_dc")).alias("dc_db"),
        )
    )


def peak_evidence(classified: DataFrame, reference: DataFrame) -> DataFrame:
    """How far the loudest block is above ``reference(rec_id, reference_db)`` and how much it rose late."""
    active = classified.filter("class = 'active'").select(
        "rec_id", "block", "frames", robust_peak().alias("peak")
    )
    totals = active.groupBy("rec_id").agg(F.sum("frames").alias("_all"))
    seen = running(
        active, ["rec_id"], slice_no("block", SLICE), ["block"], {"_before": ("sum", F.col("frames"))}, inclusive=False
    )
    half = F.floor(F.col("_all") * 0.5)
    return (
        seen.join(totals, "rec_id")
        .groupBy("rec_id")
        .agg(
            F.max("peak").alias("_max"),
            F.max(F.when(F.col("_before") < half, F.col("peak"))).alias("_early"),
        )
        .join(reference, "rec_id")
        .select(
            "rec_id",
            F.greatest(F.lit(0.0), F.col("_max") - F.col("reference_db")).alias("tail_db"),
            F.coalesce(clamp(F.col("_max") - F.col("_early"), 0.0, PEAK_RISE_DB), F.lit(0.0)).alias("novelty_db"),
        )
    )


def hum_decision(classified: DataFrame) -> DataFrame:
    """Mains hum from the quiet blocks: median level and median dominance over the block level."""
    quiet = classified.filter("class = 'quiet'").withColumns(
        {f"dom{hz}": F.col(f"hum{hz}_db") - F.col("rms_db") for hz in (50, 60)}
    )
    counts = quiet.groupBy("rec_id").agg(F.count(F.lit(1)).alias("quiet_blocks"))
    medians = counts.join(
        quantiles_of(quiet, ["rec_id"], ["hum50_db", "hum60_db", "dom50", "dom60"], "linear", 0.5), "rec_id"
    )

    def found(hz):
        return (F.col(f"m_hum{hz}_db") >= HUM_MINIMUM_DB) & (F.col(f"m_dom{hz}") >= HUM_DOMINANCE_DB)
    enough = F.col("quiet_blocks") >= HUM_QUIET_BLOCKS
    fifty = enough & found(50) & (~found(60) | (F.col("m_hum50_db") >= F.col("m_hum60_db")))
    sixty = enough & found(60) & ~fifty
    return medians.select(
        "rec_id",
        "quiet_blocks",
        F.when(fifty, 50).when(sixty, 60).otherwise(0).alias("hum_hz"),
        F.when(fifty, F.col("m_hum50_db")).when(sixty, F.col("m_hum60_db")).alias("hum_db"),
    )


def level_snapshot(
    blocks: DataFrame, extremes: DataFrame, rate: int, target_ceiling: float = -1.0, full_scan: bool = False
) -> DataFrame:
    """Programme level, advice and status per recording.

    ``extremes(rec_id, peak_db, true_peak_db, clipped, flat_tops boolean)`` are whole-recording figures.
    """
    classified = classify(blocks, rate)
    active = classified.filter("class = 'active'").withColumn("robust", robust_peak())
    by_rms = exact_quantiles(active, ["rec_id"], "rms_db", {"program_rms_db": ("linear", 0.5)})
    by_peak = exact_quantiles(active, ["rec_id"], "robust", {"_p99": ("linear", 0.99)})
    totals = active.groupBy("rec_id").agg(F.sum("frames").alias("_frames"), F.max("robust").alias("_pmax"))
    evidence = peak_evidence(classified, extremes.select("rec_id", F.col("peak_db").alias("reference_db")))
    base = (
        extremes.join(totals, "rec_id", "left")
        .join(by_rms, "rec_id", "left")
        .join(by_peak, "rec_id", "left")
        .join(evidence, "rec_id", "left")
    )
    program_peak = F.col("_pmax") if full_scan else F.col("_p99")
    narrow = F.col("peak_db") - F.col("_sample_peak") > CLICK_NARROWNESS_DB
    figures = base.withColumns(
        {"_sample_peak": program_peak, "active_seconds": F.coalesce(F.col("_frames"), F.lit(0)) / rate}
    ).withColumns(
        {
            "_premium": F.when(F.coalesce(narrow, F.lit(False)), 0.0).otherwise(
                clamp(F.col("true_peak_db") - F.col("peak_db"), 0.0, INTERSAMPLE_PREMIUM_DB)
            ),
            "_settled": F.col("active_seconds") + 1e-9 >= MINIMUM_ACTIVE_SECONDS,
        }
    ).withColumn("program_peak_db", F.col("_sample_peak") + F.col("_premium"))
    adjust = F.lit(target_ceiling) - F.col("true_peak_db")
    damaged = (F.col("clipped") > 0) | F.col("flat_tops")
    adjust = F.when(damaged, F.least(adjust, F.lit(-1.0))).otherwise(adjust)
    advice = F.when(F.col("_settled"), floor_half_db(clamp(adjust, -96.0, 96.0))).otherwise(0.0)
    status = (
        F.when(F.col("clipped") > 0, "Clipping")
        .when(F.col("flat_tops"), "UpstreamClipping")
        .when(F.col("true_peak_db") >= 0, "AboveTarget")
        .when(F.col("_frames").isNull(), "WaitingForSignal")
        .when(~F.col("_settled"), "Analyzing")
        .when(F.col("suggested_gain_db") < 0, "AboveTarget")
        .when(F.col("suggested_gain_db") > 0, "TooLow")
        .otherwise("Good")
    )
    return (
        figures.withColumn("suggested_gain_db", advice)
        .withColumn("status", status)
        .select(
            "rec_id",
            "active_seconds",
            "program_rms_db",
            "program_peak_db",
            F.greatest(F.lit(0.0), F.col("program_peak_db") - F.col("program_rms_db")).alias("crest_db"),
            "suggested_gain_db",
            (
                F.least(F.lit(0.95), 1 - F.exp(-F.col("active_seconds") / 30.0))
                / (1 + F.coalesce(F.col("novelty_db"), F.lit(0.0)) / NOVELTY_HALF_LIFE_DB)
            ).alias("confidence"),
            "status",
        )
    )


# --- end-of-side monitor, batch form -------------------------------------------------------------------

RUN_OUT_SUB_BLOCKS = 10
FLOOR_BLOCKS = 10
RUN_OUT_PEAK_DB = -60.0
MEDIUM_FLOOR_DB = -80.0


def run_out_blocks(samples: DataFrame, rate: int, response=None) -> DataFrame:
    """100 ms blocks whose level is the median of ten 10 ms levels of the high-passed signal; crossings count a non-zero
    current sample; the peak is the signal's own."""
    small, big = rate // 100, rate // 10
    w = Window.partitionBy("rec_id", "ch", "_slice").orderBy("n")
    sign = F.signum("a")
    prepared = with_halo(active(samples, rate, response), "n", before=1).withColumn("_ps", F.lag(sign).over(w)).filter("_home")
    crossing = ((sign != 0) & (sign != F.col("_ps"))).cast("int")
    sub = prepared.groupBy("rec_id", "ch", slice_no("n", small).alias("sub")).agg(
        F.sum(F.col("a") * F.col("a")).alias("p"), F.max(F.abs("v")).alias("peak"),
        F.sum(crossing).alias("zc"), F.count(F.lit(1)).alias("c"),
    )
    block = slice_no("sub", RUN_OUT_SUB_BLOCKS)
    per_channel = sub.groupBy("rec_id", "ch", block.alias("block")).agg(
        F.sum("zc").alias("zc"), F.max("peak").alias("peak"), F.sum("c").alias("c")
    ).groupBy("rec_id", "block").agg(
        F.max("zc").alias("zc"), F.max("peak").alias("peak"), F.max("c").alias("frames")
    )
    levels = (
        sub.groupBy("rec_id", "sub")
        .agg(F.sqrt(F.sum("p") / F.sum("c")).alias("rms"))
        .groupBy("rec_id", block.alias("block"))
        .agg(F.percentile(amplitude_db(F.col("rms")), F.lit(0.5)).alias("activity_rms_db"))
    )
    return per_channel.filter(F.col("frames") == big).join(levels, ["rec_id", "block"]).select(
        "rec_id", "block", "activity_rms_db", amplitude_db(F.col("peak")).alias("peak_db"),
        (F.col("zc") / (F.col("frames") / rate)).alias("zc_per_s"),
    )


def quietest_so_far(blocks: DataFrame, size: int = 4096) -> DataFrame:
    """Adds ``floor_db``: the tenth-quietest level in −80…−55 dB over all earlier blocks (null before ten).

    Per slice the ten smallest are kept; those summaries (ten numbers per 4096 blocks) are folded in order to
    give each slice its starting set, and each slice is then folded by itself.
    """
    offered = F.when(
        (F.col("activity_rms_db") >= MEDIUM_FLOOR_DB) & (F.col("activity_rms_db") <= PROGRAM_BLOCK_DB),
        F.col("activity_rms_db"),
    )
    marked = blocks.withColumn("_slice", slice_no("block", size)).withColumn("_x", offered)
    ten = F.slice(F.array_sort(F.collect_list("_x")), 1, FLOOR_BLOCKS)
    sets = marked.groupBy("rec_id", "_slice").agg(ten.alias("_ten"))

    def fold_sets(pdf):
        carry: list[float] = []
        out = []
        for row in pdf.sort_values("_slice").itertuples():
            out.append((row.rec_id, row._2, list(carry)))
            carry = sorted(carry + list(row._3))[:FLOOR_BLOCKS]
        import pandas as pd

        return pd.DataFrame(out, columns=["rec_id", "_slice", "_carry"])

    carries = sets.groupBy("rec_id").applyInPandas(fold_sets, "rec_id long, _slice long, _carry array<double>")

    def fold_slice(pdf):
        from bisect import insort

        pdf = pdf.sort_values("block")
        kept = list(pdf["_carry"].iloc[0])
        floors = []
        for x in pdf["_x"]:
            floors.append(kept[-1] if len(kept) == FLOOR_BLOCKS else None)
            if x == x and x is not None and (len(kept) < FLOOR_BLOCKS or x < kept[-1]):
                insort(kept, x)
                del kept[FLOOR_BLOCKS:]
        pdf["floor_db"] = floors
        pdf["floor_db"] = pdf["floor_db"].astype("float64")
        return pdf[["rec_id", "block", "floor_db"]]

    floors = (
        marked.select("rec_id", "block", "_slice", "_x")
        .join(carries, ["rec_id", "_slice"])
        .groupBy("rec_id", "_slice")
        .applyInPandas(fold_slice, "rec_id long, block long, floor_db double")
    )
    return blocks.join(floors, ["rec_id", "block"])


def fading_tail(blocks: DataFrame) -> DataFrame:
    """Adds ``fading``: three successive ten-block medians each fall by 0.15 dB and the last is above the floor."""
    haloed = with_halo(blocks, "block", before=29)
    w = halo_window(["rec_id"], "block")

    def median(low, high):
        return F.percentile("activity_rms_db", F.lit(0.5)).over(w.rowsBetween(low, high))

    full = F.count(F.lit(1)).over(w.rowsBetween(-29, 0)) == 30
    out = haloed.withColumns(
        {"_a": median(-29, -20), "_b": median(-19, -10), "_c": median(-9, 0), "_full": full}
    ).filter("_home")
    near_floor = F.col("floor_db").isNotNull() & (F.col("_c") <= F.col("floor_db") + 1.5)
    finite = is_finite(F.col("_a")) & is_finite(F.col("_b")) & is_finite(F.col("_c"))
    fading = (
        F.col("_full") & finite & ~near_floor
        & (F.col("_a") - F.col("_b") >= 0.15) & (F.col("_b") - F.col("_c") >= 0.15)
    )
    return out.withColumn("fading", fading).drop("_a", "_b", "_c", "_full", "_slice", "_home")


def run_out_program(blocks_with_floor: DataFrame, rate: int, minimum_peak: float = RUN_OUT_PEAK_DB) -> DataFrame:
    threshold = F.coalesce(
        F.greatest(F.lit(PROGRAM_BLOCK_DB), F.col("floor_db") + SEPARATION_DB), F.lit(PROGRAM_BLOCK_DB)
    )
    return blocks_with_floor.withColumn("program", is_program(threshold, rate, minimum_peak))


SETTLING_BLOCKS = 30


def last_program(blocks: DataFrame) -> DataFrame:
    """As-of: number of the latest programme block at or before each block, and of the first one."""
    return running(
        blocks, ["rec_id"], slice_no("block", SLICE), ["block"],
        {"last_program": ("max", F.when(F.col("program"), F.col("block"))),
         "first_program": ("min", F.when(F.col("program"), F.col("block")))},
    )


def waiting(asof: DataFrame) -> DataFrame:
    """Adds ``since`` (the block from which the hold counts) to blocks with program, fading, first_program.

    Programme restarts the hold at its block. A fade, once thirty blocks of the side have been heard, keeps the side open
    and restarts it three seconds later, when the level has settled. So one running maximum over such events is the whole
    state of the monitor: the latest event decides, and a block counts for the hold when it lies past its restart.
    """
    heard = F.col("first_program").isNotNull() & (F.col("block") - F.col("first_program") >= 29)
    event = F.when(F.col("program"), 2 * F.col("block")).when(F.col("fading") & heard, 2 * F.col("block") + 1)
    seen = running(asof, ["rec_id"], slice_no("block", SLICE), ["block"], {"_event": ("max", event)})
    block, fade = F.floor(F.col("_event") / 2), F.col("_event") % 2
    return seen.withColumn("since", (block + fade * SETTLING_BLOCKS).cast("long")).withColumn(
        "preserved_to", block.cast("long")).drop("_event")


def hold_trigger(asof: DataFrame, hold_seconds: float = 12.0, keep_seconds: float = 4.0) -> DataFrame:
    """First block at which the hold has passed (see ``waiting``), and the block the take is trimmed to."""
    hold = min(60.0, max(5.0, hold_seconds))
    return (
        waiting(asof).filter((F.col("block") - F.col("since")) / 10 >= hold)
        .groupBy("rec_id")
        .agg(F.min("block").alias("trigger_block"), F.min_by("last_program", "block").alias("last_program"),
             F.min_by("preserved_to", "block").alias("_to"))
        .select("rec_id", "trigger_block", "last_program",
                F.least("trigger_block", F.col("_to") + int(keep_seconds * 10)).alias("keep_to_block"))
    )
