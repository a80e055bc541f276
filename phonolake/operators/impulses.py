"""Clicks and pops: two detector passes over a recording and the merge of what they find.

Samples are read once, slice by slice, for the local levels; what is left then are the samples that can open an event and
what its gates look at around them. Every later step works on that sparse table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.functions.levels import clamp01
from phonolake.operators.detect import score_impulses
from phonolake.operators.ordered import SLICE, greedy_groups, islands, running, slice_no, with_halo
from phonolake.session import stage

WIDEN = 0.45  # of the threshold: how far a candidate is widened
LOUD = 1.5  # of the reference level: what belongs to an outlier
KEYS = ["rec_id", "ch"]


@dataclass(frozen=True)
class Limits:
    """What a sensitivity of 1 to 10 and the two lengths mean at one rate."""

    rate: int
    sensitivity: float = 7.0
    click_ms: float = 0.35
    pop_ms: float = 5.0

    @property
    def turn(self) -> float:
        return (min(10.0, max(1.0, self.sensitivity)) - 1) / 9

    @property
    def click(self) -> int:
        return max(1, round(self.rate * self.click_ms / 1000))

    @property
    def pop(self) -> int:
        return max(self.click, round(self.rate * self.pop_ms / 1000))

    @property
    def rest(self) -> int:
        """Samples passed over behind a candidate."""
        return max(1, min(round(self.rate * 0.00018), max(1, self.pop // 3)))

    @property
    def block(self) -> int:
        return max(4, int(self.rate * 0.025))

    @property
    def envelope(self) -> int:
        return max(16, self.rate // 200)

    @property
    def outlier(self) -> float:
        return 8.0 - 5.0 * self.turn


def _middle(rows: np.ndarray) -> np.ndarray:
    """Median of each row, missing values left out; NaN where a row has none."""
    ordered, count = np.sort(rows, axis=1), np.sum(~np.isnan(rows), axis=1)
    pick = lambda k: np.take_along_axis(ordered, k[:, None], axis=1)[:, 0]
    return 0.5 * pick(np.maximum(count - 1, 0) // 2) + 0.5 * pick(np.minimum(count // 2, rows.shape[1] - 1))


def _levels(v: np.ndarray, limits: Limits) -> tuple[np.ndarray, ...]:
    """(curvature, threshold, reference, rms) of every sample of whole blocks, given a quarter block and one sample more on
    both sides; missing samples are NaN."""
    t, size = limits.turn, limits.block
    quarter = size // 4
    curvature = np.full(len(v), np.nan)
    curvature[1:-1] = np.abs(v[1:-1] - (v[:-2] + v[2:]) / 2)
    near = lambda x: np.lib.stride_tricks.sliding_window_view(x[1:-1], size + 2 * quarter)[::size]
    home = slice(quarter + 1, len(v) - quarter - 1)
    bends, values = near(curvature), near(v)
    count = np.sum(~np.isnan(values), axis=1)
    rms = np.sqrt(np.nansum(values * values, axis=1) / np.where(count, count, np.nan))
    middle, loud = _middle(bends), _middle(np.abs(v[home].reshape(-1, size)))
    spread = _middle(np.abs(bends - middle[:, None]))
    scale = np.fmax(np.fmax(1.4826 * spread, 0.25 * middle), np.fmax(rms * (0.008 - 0.0065 * t), 2e-7))
    known = (middle + (15 - 9.5 * t) * scale, np.fmax(1.13 * loud, 0.5 * rms), rms)
    return curvature[home], *(np.repeat(x, size) for x in known)


def marked_samples(samples: DataFrame, limits: Limits) -> DataFrame:
    """Samples around those that can open an event: (rec_id, ch, n, v, curvature, threshold, reference, rms, low, high).

    An event opens where a sample is bent beyond its block's curvature threshold or lies beyond the outlier gate; all
    samples that its candidates and gates look at are kept. A block is 25 ms; threshold and RMS look at a quarter block
    more on both sides, the reference level (1.13 of the median, at least half the RMS) at the block alone. Every sample
    is judged by the levels of its own block. ``low`` and ``high`` bound the run beyond 0.45 of the threshold around a
    bent sample, as far as the longest pop reaches (null elsewhere).

    Slices of whole blocks are solved on their own, with a halo of that reach. NaN counts as a missing sample.
    """
    size, pop = limits.block, limits.pop
    reach = pop + max(8, limits.envelope, 4 * pop, 3 * pop + 2) + 2
    span = max(SLICE // size, -(-8 * reach // size)) * size
    blocks = -(-(reach + pop) // size) * size  # whole blocks of the neighbours
    halo = blocks + size // 4 + 1
    sliced = with_halo(samples.select(*KEYS, "n", "v").filter("n IS NOT NULL"), "n", before=halo, after=halo, size=span)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*KEYS).schema)

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["_slice"].iloc[0]) * span - halo
        at = pdf["n"].to_numpy(np.int64) - first
        v = np.full(span + 2 * halo, np.nan)
        v[at] = pdf["v"].to_numpy(float)
        there = np.zeros(len(v), bool)
        there[at] = True
        edge = size // 4 + 1
        curvature, threshold, reference, rms = _levels(v, limits)
        v, there = v[edge:-edge], there[edge:-edge]
        loud = np.abs(v)
        strong = curvature > threshold
        outlier = (loud > LOUD * reference) & (loud / np.fmax(1e-9, reference + 0.1 * rms) >= limits.outlier)
        opens = np.concatenate([[0], np.cumsum(strong | outlier)])
        place = np.arange(len(v))
        near = opens[np.minimum(place + reach + 1, len(v))] > opens[np.maximum(place - reach, 0)]
        hot = curvature > WIDEN * threshold
        low = np.maximum.accumulate(np.where(hot, -1, place)) + 1
        high = np.minimum.accumulate(np.where(hot, len(v), place)[::-1])[::-1] - 1
        low, high = np.maximum(low, place - pop), np.minimum(high, place + pop)
        keep = near & there
        keep[:blocks] = keep[blocks + span:] = False
        k = np.flatnonzero(keep)
        n = k + first + edge
        out = {c: pdf[c].iloc[0] for c in KEYS} | {"n": n, "v": v[k]}
        for name, x in (("curvature", curvature), ("threshold", threshold), ("reference", reference), ("rms", rms)):
            out[name] = x[k]
        for name, x in (("low", low), ("high", high)):
            out[name] = pd.Series(np.where(strong[k], n + x[k] - k, 0), dtype="Int64").mask(~strong[k])
        return pd.DataFrame(out)

    figures = "n long, v double, curvature double, threshold double, reference double, rms double, low long, high long"
    marked = sliced.groupBy(*KEYS, "_slice").applyInPandas(mark, f"{types}, {figures}")
    return marked.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("v", "curvature", "threshold", "reference", "rms")})


def bent_spans(marked: DataFrame, limits: Limits) -> DataFrame:
    """Candidates of the curvature pass: (rec_id, ch, start, end, peak, ratio).

    The first sample beyond the threshold opens a candidate, all others within the longest pop belong to it; it is
    widened over samples beyond 0.45 of the threshold without becoming longer than that, and the search goes on a
    short rest behind it. The marked samples are read twice.
    """
    strong = marked.filter(F.col("curvature") > F.col("threshold")).select(
        *KEYS, "n", "low", "high", (F.col("curvature") / F.col("threshold")).alias("_q"), "curvature")
    members = greedy_groups(strong, KEYS, "n", limits.pop, limits.rest, "low", "high")
    return members.join(strong, [*KEYS, "n"]).groupBy(*KEYS, "start", "end").agg(
        F.max_by("n", F.struct(F.col("curvature"), -F.col("n"))).alias("peak"), F.max("_q").alias("ratio"))


def loud_spans(marked: DataFrame, samples: DataFrame, limits: Limits) -> DataFrame:
    """Events of the amplitude pass: (rec_id, ch, start, end, confidence, severity).

    A run above 1.5 of the reference level, no longer than the longest pop, with a sample beyond the outlier gate (3 to
    8 times the level). It must be back near its start soon after, and what follows must not be 2.5 times louder than
    what came before. A run needs 5 ms of signal on both sides, so nothing at the very ends is decided.
    """
    beyond = F.abs("v") / F.greatest(F.lit(1e-9), F.col("reference") + 0.1 * F.col("rms"))
    first = F.when(beyond >= limits.outlier, F.struct(F.col("n"), beyond.alias("q")))
    loud = marked.filter(F.abs("v") > LOUD * F.col("reference"))
    runs = islands(loud, KEYS, "n", {"first": ("min", first)}).filter(
        F.col("first").isNotNull() & (F.col("last") - F.col("start") < limits.pop))
    spans = runs.select(*KEYS, F.col("start").alias("_s"), (F.col("last") + 1).alias("_e"), F.col("first.q").alias("_q"))
    size, n, v = F.col("_e") - F.col("_s"), F.col("n"), F.col("v")
    back = F.col("_e") + F.greatest(F.lit(2), size)
    reach = F.greatest(F.lit(limits.envelope), F.greatest(F.lit(2), size) + 3 * size)
    near = spans.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_s") - limits.envelope), F.col("_e") + reach))).join(
        samples.select(*KEYS, "n", "v").hint("merge"), [*KEYS, "n"])
    inside = (n >= F.col("_s")) & (n < F.col("_e"))
    later = (n >= back) & (n < back + 3 * size)
    before, after = n < F.col("_s"), (n >= F.col("_e")) & (n < F.col("_e") + limits.envelope)
    figures = near.groupBy(*KEYS, "_s", "_e", "_q").agg(
        F.max(F.when(n == F.col("_s") - 1, v)).alias("_at"),
        *[f(F.when(c, v)).alias(a) for c, hi, lo in ((inside, "_ih", "_il"), (later, "_lh", "_ll")) for f, a in ((F.max, hi), (F.min, lo))],
        F.count_if(later).alias("_later"), F.count_if(before).alias("_before"), F.count_if(after).alias("_after"),
        F.sqrt(F.avg(F.when(before, v * v))).alias("_rb"), F.sqrt(F.avg(F.when(after, v * v))).alias("_ra"))

    def away(high, low):
        return F.greatest(F.abs(F.col(high) - F.col("_at")), F.abs(F.col(low) - F.col("_at")))

    confidence = clamp01(0.65 + (F.col("_q") - limits.outlier) / 20.0)
    return figures.filter(
        (F.col("_before") == limits.envelope) & (F.col("_after") == limits.envelope) & (F.col("_later") >= 2)
        & (away("_ih", "_il") > 1e-9) & (away("_lh", "_ll") <= 0.5 * away("_ih", "_il"))
        & (F.col("_ra") <= 2.5 * F.col("_rb"))
    ).select(*KEYS, F.col("_s").alias("start"), F.col("_e").alias("end"), confidence.alias("confidence"),
             clamp01((F.col("_q") - 5.0) / 15.0).alias("severity"))


def merge_impulses(events: DataFrame, limits: Limits) -> DataFrame:
    """Touching events become one: (rec_id, ch, kind, start, end, confidence, severity, merged).

    Events touch when one starts at or before the sample after another's end. A connected run no longer than the longest pop is one
    event with the run's extent. A longer run is no impulse as a whole: it is cut into pieces of events that start
    within that length of the piece's first, and a piece that is still too long is represented by its most severe event
    alone (ties: the earlier, then the shorter). The kind is decided anew from the length.
    """
    order, place = ["start", "end", "confidence", "severity"], slice_no("start", SLICE)
    seen = running(events, KEYS, place, order, {"_reach": ("max", F.col("end"))}, inclusive=False)
    fresh = F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + 1), 1).otherwise(0)
    chained = stage(running(seen.withColumn("_new", fresh), KEYS, place, order, {"_chain": ("sum", F.col("_new"))}).select(
        *KEYS, *order, "_chain"), "chains")
    lengths = chained.groupBy(*KEYS, "_chain").agg((F.max("end") - F.min("start")).alias("_length"))
    sized = chained.join(lengths, [*KEYS, "_chain"])
    short = sized.filter(F.col("_length") <= limits.pop).withColumn("_piece", F.lit(-1).cast("long"))
    long = sized.filter(F.col("_length") > limits.pop)
    pieces = greedy_groups(long.select(*KEYS, "_chain", "start").distinct(), [*KEYS, "_chain"], "start", limits.pop).select(
        *KEYS, "_chain", F.col("n").alias("start"), F.col("first").alias("_piece"))
    cut = long.join(pieces, [*KEYS, "_chain", "start"])
    best = F.max_by(F.struct("start", "end", "confidence", "severity"), F.struct(F.col("severity"), -F.col("start"), -F.col("end"), F.col("confidence")))
    whole = F.col("_hi") - F.col("_lo") <= limits.pop
    merged = short.unionByName(cut).groupBy(*KEYS, "_chain", "_piece").agg(
        F.min("start").alias("_lo"), F.max("end").alias("_hi"), F.max("confidence").alias("_c"), F.max("severity").alias("_s"),
        best.alias("_b"), F.count(F.lit(1)).alias("merged"))
    out = merged.select(
        *KEYS, F.when(whole, F.col("_lo")).otherwise(F.col("_b.start")).alias("start"),
        F.when(whole, F.col("_hi")).otherwise(F.col("_b.end")).alias("end"),
        F.when(whole, F.col("_c")).otherwise(F.col("_b.confidence")).alias("confidence"),
        F.when(whole, F.col("_s")).otherwise(F.col("_b.severity")).alias("severity"), "merged")
    return out.withColumn("kind", F.when(F.col("end") - F.col("start") <= limits.click, "click").otherwise("pop"))


def impulse_events(samples: DataFrame, limits: Limits, minimum_confidence: float = 0.65) -> DataFrame:
    """Both passes and their merge. Null samples and recordings shorter than a block context find nothing."""
    found = both_passes(stage(marked_samples(samples, limits), "marked"), limits).filter(F.col("confidence") >= minimum_confidence)
    # The merge reads its events several times: each reading would run both passes again, at the same time.
    return merge_impulses(stage(found, "found"), limits)


def both_passes(marked: DataFrame, limits: Limits) -> DataFrame:
    """Scored events of the two passes over the marked samples, not merged and of any confidence."""
    fields = [*KEYS, "start", "end", "confidence", "severity"]
    bent = score_impulses(bent_spans(marked, limits), marked, limits.rate).select(*fields)
    return bent.unionByName(loud_spans(marked, marked, limits).select(*fields))
