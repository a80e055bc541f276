"""Where a side divides into tracks: heaviest compatible splits, exact counts and the threshold sweep.

Candidates at least the minimum track apart never compete, so a choice falls apart into clusters of close candidates.
Clusters are solved and combined ``FAN`` at a time, round after round, each report holding at most 98 counts of splits
with their positions; no task sees a recording. Only the candidates of one cluster meet in one place.

Silences are given per setting (``threshold_db``) or, where one is quiet from a level upward, once with ``from_db``. Then
a place keeps its heaviest candidate per level, and settings that hear the same silences are answered once.

Of equally heavy choices the one stands whose latest split is earliest, then the one before it, and so on; of two
that agree as far as the shorter goes, the shorter.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonolake.operators.ordered import running, slice_no
from phonolake.session import stage

KEYS = ["rec_id", "threshold_db"]
FAN = 64
#: A disc holds at most 99 tracks.
MAXIMUM_SPLITS = 98
MINIMUM_PLATEAU_DB = 4.0


def split_candidates(silences: DataFrame, frames: DataFrame, minimum_track: int, level: str = "threshold_db") -> DataFrame:
    """Middles of silences far enough from both ends: (rec_id, level, position, weight)."""
    middle = F.col("start") + F.floor((F.col("end") - F.col("start")) / 2)
    return (
        silences.join(frames, "rec_id")
        .select("rec_id", level, middle.alias("position"), (F.col("end") - F.col("start")).alias("weight"), "frames")
        .filter((F.col("position") >= minimum_track) & (F.col("frames") - F.col("position") >= minimum_track))
        .drop("frames")
    )


def _posed(
    silences: DataFrame, frames: DataFrame, minimum_track: int, settings: Sequence[float] | None
) -> tuple[DataFrame, DataFrame]:
    """Candidates (rec_id, threshold_db, position, weight) to be solved, and what is asked: (rec_id, frames, threshold_db,
    _solved), ``_solved`` being the setting whose candidates answer it.

    Of silences with ``from_db`` a setting hears all of lower levels too. Of candidates at one place only the heaviest is
    ever taken, so a place holds at most one row per level, whatever the number of silences.
    """
    if "from_db" not in silences.columns:
        asked = silences.select(*KEYS).distinct().join(frames, "rec_id") if settings is None else _grid(frames, settings)
        return split_candidates(silences, frames, minimum_track), asked.withColumn("_solved", F.col("threshold_db"))
    if settings is None:
        raise ValueError("silences from a level upward need settings")
    all_settings = F.array(*[F.lit(float(db)) for db in settings])
    heard = F.array_min(F.filter(all_settings, lambda db: db >= F.col("from_db")))
    places = stage(
        split_candidates(silences.withColumn("_heard", heard).filter("_heard IS NOT NULL"), frames, minimum_track, "_heard")
        .groupBy("rec_id", "_heard", "position").agg(F.max("weight").alias("weight")), "places")
    levels = places.groupBy("rec_id").agg(F.array_sort(F.collect_set("_heard")).alias("_levels"))
    held = places.groupBy("rec_id", "position").agg(F.collect_list(F.struct("_heard", "weight")).alias("_held")).join(levels, "rec_id")
    heaviest_at = lambda db: F.array_max(F.transform(F.filter("_held", lambda h: h["_heard"] <= db), lambda h: h["weight"]))
    rows = F.inline(F.transform("_levels", lambda db: F.struct(db.alias("threshold_db"), heaviest_at(db).alias("weight"))))
    candidates = stage(held.select("rec_id", "position", rows).filter("weight IS NOT NULL").select(*KEYS, "position", "weight"), "candidates")
    at_most = F.array_max(F.filter("_levels", lambda db: db <= F.col("threshold_db")))
    asked = _grid(frames, settings).join(levels, "rec_id", "left").withColumn("_solved", at_most).drop("_levels")
    return candidates, asked


def _answered(asked: DataFrame, found: DataFrame) -> DataFrame:
    return asked.join(found.withColumnRenamed("threshold_db", "_solved"), ["rec_id", "_solved"], "left")


def clusters(candidates: DataFrame, minimum_track: int) -> DataFrame:
    """Adds ``cluster``, counted from 0 per key: a candidate opens one if the last lies a minimum track back."""
    slices = slice_no("position", 64 * minimum_track)
    before = running(candidates, KEYS, slices, ["position"], {"_prev": ("max", F.col("position"))}, inclusive=False)
    apart = F.col("_prev").isNull() | (F.col("position") - F.col("_prev") >= minimum_track)
    numbered = running(before.withColumn("_new", apart.cast("long")), KEYS, slices, ["position"], {"_no": ("sum", F.col("_new"))})
    return numbered.select(*KEYS, "position", "weight", (F.col("_no") - 1).alias("cluster"))


def _compatible(at: Sequence[int], apart: int) -> np.ndarray:
    """For every position, how many lie at least ``apart`` before it."""
    at = np.asarray(at, np.int64)
    return np.searchsorted(at, at - apart, "right")


def heaviest(at: Sequence[int], weight: Sequence[int], apart: int) -> tuple[int, list[int]]:
    """Heaviest selection of rising positions at least ``apart`` from each other."""
    n = len(at)
    total, taken = [0] * (n + 1), [False] * (n + 1)
    compatible = _compatible(at, apart).tolist()
    for i in range(1, n + 1):
        with_it = weight[i - 1] + total[compatible[i - 1]]
        taken[i] = with_it > total[i - 1]
        total[i] = with_it if taken[i] else total[i - 1]
    kept, i = [], n
    while i:
        if taken[i]:
            kept.append(at[i - 1])
            i = compatible[i - 1]
        else:
            i -= 1
    return total[n], kept[::-1]


def profile(at: Sequence[int], weight: Sequence[int], apart: int, most: int) -> dict[int, tuple[int, list[int]]]:
    """For every possible number of splits up to ``most``: the best weight and its positions, latest first."""
    at, weight, compatible = np.asarray(at, np.int64), np.asarray(weight, np.int64), _compatible(at, apart)
    impossible = np.iinfo(np.int64).min // 2
    total, taken = np.zeros(len(at) + 1, np.int64), [np.array([], np.int64)]
    out = {0: (0, [])}
    for k in range(1, most + 1):
        with_it = total[compatible] + weight
        with_it[with_it <= 0] = impossible
        total = np.maximum.accumulate(np.append(impossible, with_it))
        if total[-1] < 0:
            break
        taken.append(np.flatnonzero(with_it > total[:-1]))
        kept, before = [], len(at)
        for left in range(k, 0, -1):
            last = taken[left][np.searchsorted(taken[left], before) - 1]
            kept.append(int(at[last]))
            before = compatible[last]
        out[k] = (int(total[-1]), kept)
    return out


def combined(left: dict, right: dict, most: int) -> dict:
    """The report of two neighbouring stretches, ``left`` before ``right``."""
    out: dict[int, tuple[int, list[int]]] = {}
    for b, (wb, pb) in right.items():
        for a, (wa, pa) in left.items():
            k, w = a + b, wa + wb
            if k > most or (k in out and out[k][0] > w):
                continue
            kept = pb + pa
            if k not in out or w > out[k][0] or kept < out[k][1]:
                out[k] = (w, kept)
    return out


def strongest_splits(
    silences: DataFrame, frames: DataFrame, minimum_track: int, settings: Sequence[float] | None = None
) -> DataFrame:
    """Heaviest compatible set per (rec_id, threshold): (…, boundaries) including 0 and the length.

    With ``settings`` every recording answers at each of them, with a single track where nothing is quiet; without, at
    the thresholds it has silences for.
    """
    candidates, asked = _posed(silences, frames, minimum_track, settings)
    near = clusters(candidates, minimum_track).withColumn("_pack", slice_no("cluster", FAN))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for _, part in pdf.sort_values(["cluster", "position"]).groupby("cluster"):
            kept += heaviest(part["position"].tolist(), part["weight"].tolist(), minimum_track)[1]
        return pd.DataFrame({"rec_id": pdf["rec_id"].iloc[0], "threshold_db": pdf["threshold_db"].iloc[0], "position": kept})

    chosen = near.groupBy(*KEYS, "_pack").applyInPandas(choose, "rec_id long, threshold_db double, position long")
    inner = chosen.groupBy(*KEYS).agg(F.array_sort(F.collect_list("position")).alias("_inner"))
    return _answered(asked, inner).select(*KEYS, _bounded(F.col("_inner")).alias("boundaries"))


def exact_splits(
    silences: DataFrame, frames: DataFrame, minimum_track: int, tracks: int, settings: Sequence[float] | None = None
) -> DataFrame:
    """Heaviest set giving exactly ``tracks`` tracks: (rec_id, threshold_db, boundaries, exact).

    Where no set gives that many, the strongest set stands with ``exact`` false. ``settings`` as in ``strongest_splits``.
    """
    wanted = tracks - 1
    if not 0 <= wanted <= MAXIMUM_SPLITS:
        raise ValueError("a disc holds 1 to 99 tracks")
    types = "rec_id long, threshold_db double, node long, k long, weight long, splits array<long>"
    columns = ["rec_id", "threshold_db", "node", "k", "weight", "splits"]

    def report(pdf: pd.DataFrame, parts: list[dict]) -> pd.DataFrame:
        whole = parts[0]
        for part in parts[1:]:
            whole = combined(whole, part, wanted)
        head = (pdf["rec_id"].iloc[0], pdf["threshold_db"].iloc[0], pdf["_pack"].iloc[0])
        return pd.DataFrame([(*head, k, w, kept) for k, (w, kept) in whole.items()], columns=columns)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = pdf.sort_values(["cluster", "position"]).groupby("cluster")
        return report(pdf, [profile(g["position"].tolist(), g["weight"].tolist(), minimum_track, wanted) for _, g in groups])

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = pdf.sort_values(["node", "k"]).groupby("node")
        return report(pdf, [{r.k: (int(r.weight), list(r.splits)) for r in g.itertuples()} for _, g in groups])

    candidates, asked = _posed(silences, frames, minimum_track, settings)
    near = clusters(candidates, minimum_track)
    nodes = stage(near.withColumn("_pack", slice_no("cluster", FAN)).groupBy(*KEYS, "_pack").applyInPandas(solve, types), "splits")
    last = nodes.agg(F.max("node")).first()[0] or 0
    while last > 0:
        last //= FAN
        nodes = nodes.withColumn("_pack", slice_no("node", FAN)).groupBy(*KEYS, "_pack").applyInPandas(unite, types)
    rank = F.struct((F.col("k") != wanted).alias("short"), (-F.col("weight")).alias("light"), F.col("splits").alias("splits"))
    best = nodes.groupBy(*KEYS).agg(F.min(rank).alias("_best"))
    exact = F.size("boundaries") == tracks + 1
    return _answered(asked, best).select(
        *KEYS, _bounded(F.reverse("_best.splits")).alias("boundaries")).withColumn("exact", exact)


def _grid(frames: DataFrame, settings: Sequence[float]) -> DataFrame:
    grid = F.explode(F.array(*[F.lit(float(db)) for db in settings]))
    return frames.select("rec_id", "frames", grid.alias("threshold_db"))


def _bounded(inner: Column) -> Column:
    none = F.array().cast("array<long>")
    return F.concat(F.array(F.lit(0).cast("long")), F.coalesce(inner, none), F.array(F.col("frames").cast("long")))


def plateaus(boundaries: DataFrame, tolerance: int) -> DataFrame:
    """Runs of settings whose boundaries agree with the run's first answer: (rec_id, tracks, low_db, high_db, chosen_db, boundaries).

    Settings are compared place by place, so one row holds the settings of a recording (46) at one place, never its
    boundaries; a setting's run ends at the first higher setting that differs from it anywhere. The setting in the
    middle speaks for the run; settings are whole decibels.
    """
    places = boundaries.select(*KEYS, F.size("boundaries").alias("_size"), F.posexplode("boundaries").alias("_ord", "_at"))
    held = places.groupBy("rec_id", "_ord").agg(F.collect_list(F.struct("threshold_db", "_size", "_at")).alias("_all"))

    def unlike(a: Column) -> Column:
        other = F.filter("_all", lambda b: (b["threshold_db"] > a["threshold_db"]) & (
            (b["_size"] != a["_size"]) | (F.abs(b["_at"] - a["_at"]) > tolerance)))
        return F.array_min(F.transform(other, lambda b: b["threshold_db"]))

    broken = held.select("rec_id", F.inline(F.transform("_all", lambda a: F.struct(a["threshold_db"].alias("low"), unlike(a).alias("next")))))
    links = broken.groupBy("rec_id", "low").agg(F.min("next").alias("next")).groupBy("rec_id").agg(
        F.array_sort(F.collect_list(F.struct("low", "next"))).alias("_links"))
    runs = links.select("rec_id", "_links", F.explode(F.expr(
        "aggregate(_links, named_struct('at', _links[0].low, 'runs', cast(array() as array<struct<low:double,next:double>>)), "
        "(acc, l) -> if(l.low = acc.at, named_struct('at', l.next, 'runs', array_append(acc.runs, l)), acc), acc -> acc.runs)")).alias("_run"))
    inside = F.filter("_links", lambda l: (l["low"] >= F.col("_run.low")) & (F.col("_run.next").isNull() | (l["low"] < F.col("_run.next"))))
    spans = runs.select("rec_id", F.col("_run.low").alias("low_db"), F.array_max(F.transform(inside, lambda l: l["low"])).alias("high_db"))
    middle = (F.col("low_db") + F.col("high_db")) / 2
    chosen = F.signum(middle) * F.floor(F.abs(middle) + 0.5)  # half away from zero
    answers = boundaries.select("rec_id", F.col("threshold_db").alias("chosen_db"), "boundaries")
    return spans.withColumn("chosen_db", chosen).join(answers, ["rec_id", "chosen_db"]).select(
        "rec_id", (F.size("boundaries") - 1).cast("long").alias("tracks"), "low_db", "high_db", "chosen_db", "boundaries")


def choose_plateau(candidates: DataFrame, tracks: int | None = None) -> DataFrame:
    """Ranked by width, then by lowest setting, with ``best``: the first wide multi-track answer, else the first single
    track, else the first; with ``tracks`` the first of that many, or none."""
    width = F.col("high_db") - F.col("low_db")
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("rec_id").orderBy(width.desc(), F.col("low_db"))))
    if tracks is not None:
        grade = F.when(F.col("tracks") == tracks, 0)
    else:
        grade = F.when((F.col("tracks") > 1) & (width >= MINIMUM_PLATEAU_DB), 0).when(F.col("tracks") == 1, 1).otherwise(2)
    order = Window.partitionBy("rec_id").orderBy(grade.asc_nulls_last(), "rank")
    return ranked.withColumn("best", (F.row_number().over(order) == 1) & grade.isNotNull())


def sweep_tracks(
    silences: DataFrame, frames: DataFrame, settings: Sequence[float], minimum_track: int, tolerance: int, gap: int,
    tracks: int | None = None,
) -> DataFrame:
    """The whole sweep: plateaus of every recording with rank, ``best`` and ``relaxed``.

    ``silences`` are found at the relaxed (shorter) gap. Those of at least ``gap`` decide first; a recording that no
    setting divides with them is looked at again with all its silences, and keeps that answer if it divides then.
    """

    def answers(quiet: DataFrame, asked: DataFrame) -> DataFrame:
        found = (strongest_splits(quiet, asked, minimum_track, settings) if tracks is None
                 else exact_splits(quiet, asked, minimum_track, tracks, settings))
        return stage(plateaus(found.select(*KEYS, "boundaries"), tolerance), "plateaus")

    first = answers(silences.filter(F.col("end") - F.col("start") >= gap), frames)
    whole = frames.join(first.filter("tracks > 1").select("rec_id").distinct(), "rec_id", "left_anti")
    second = answers(silences.join(whole.select("rec_id"), "rec_id", "left_semi"), whole)
    divided = second.filter("tracks > 1").select("rec_id").distinct()
    candidates = first.join(divided, "rec_id", "left_anti").withColumn("relaxed", F.lit(False)).unionByName(
        second.join(divided, "rec_id", "left_semi").withColumn("relaxed", F.lit(True)))
    return choose_plateau(candidates, tracks)


def sweep_sentences(candidates: DataFrame, tracks: int | None = None) -> DataFrame:
    """What a sweep found, in one sentence per recording of ``sweep_tracks``."""
    best = F.max_by(F.struct("tracks", "low_db", "high_db", "relaxed"), F.col("best").cast("int"))
    found = candidates.groupBy("rec_id").agg(
        best.alias("_b"), F.bool_or("best").alias("_any"), F.array_sort(F.collect_set("tracks")).alias("_all"))
    where = F.format_string("%d tracks, the same from %.0f to %.0f dB", F.col("_b.tracks"), F.col("_b.low_db"), F.col("_b.high_db"))
    short = F.when(F.col("_b.relaxed"), ", by shorter gaps").otherwise("")
    never = F.format_string(f"never {tracks} tracks; settings give %s", F.array_join(F.col("_all").cast("array<string>"), ", "))
    one = F.lit("one track, no gap divides it")
    said = F.when(~F.col("_any"), never).when(F.col("_b.tracks") > 1, F.concat(where, short)).otherwise(one)
    return found.select("rec_id", said.alias("sentence"))
