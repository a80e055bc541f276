"""Groups that hang on their first point, and the click detector built on them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phonolake.operators import impulses as I
from phonolake.operators.ordered import greedy_groups


def walk(points, span, skip):
    """(n, first, last, start, end) by one walk over the sorted (n, low, high)."""
    out, i = [], 0
    while i < len(points):
        inside = [p for p in points[i:] if p[0] < points[i][0] + span]
        last = inside[-1][0]
        start = max(points[i][1], last + 1 - span)
        end = min(inside[-1][2] + 1, start + span)
        out += [(p[0], points[i][0], last, start, end) for p in inside]
        i += len(inside)
        while i < len(points) and points[i][0] < end + skip:
            i += 1
    return out


@pytest.mark.parametrize("density,span,skip,seed", [(0.02, 10, 3, 1), (0.3, 7, 2, 2), (0.9, 5, 1, 3), (1.0, 6, 4, 4), (0.5, 4, 0, 5)])
def test_groups_equal_a_walk(spark, density, span, skip, seed):
    draw = np.random.default_rng(seed)
    rows, want = [], []
    for key in ("a", "b"):
        pos = np.flatnonzero(draw.random(700) < density)
        pieces = np.cumsum(np.diff(pos, prepend=-9) > 1)
        low = [int(pos[pieces == p].min()) for p in pieces]
        high = [int(pos[pieces == p].max()) for p in pieces]
        points = list(zip(pos.tolist(), low, high))
        rows += [(key, *p) for p in points]
        want += [(key, *w) for w in walk(points, span, skip)]
    points = spark.createDataFrame(rows, "k string, n long, low long, high long")
    got = greedy_groups(points, ["k"], "n", span, skip, "low", "high", size=47)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_no_points_and_null_keys(spark):
    empty = spark.createDataFrame([], "k string, n long")
    assert greedy_groups(empty, ["k"], "n", 5).count() == 0
    some = spark.createDataFrame([(None, 3), ("a", None), ("a", 4)], "k string, n long")
    assert [tuple(r) for r in greedy_groups(some, ["k"], "n", 5).collect()] == [("a", 4, 4, 4, 4, 5)]
    with pytest.raises(ValueError):
        greedy_groups(some, ["k"], "n", 50, size=100)


def signal(spark, pulses, size=48_000, rate=48_000):
    n = np.arange(size)
    v = 0.05 * np.sin(2 * np.pi * 220 * n / rate) + 0.0005 * np.random.default_rng(7).standard_normal(size)
    for at, shape in pulses:
        v[at:at + len(shape)] += shape
    return spark.createDataFrame(pd.DataFrame({"rec_id": 0, "ch": 0, "n": n, "v": v}))


def test_planted_clicks_and_pops_are_found_and_music_is_not(spark):
    thump = 0.7 * np.sin(np.linspace(0, np.pi, 90))
    pulses = [(5_000, [0.6]), (15_000, [0.5, -0.6, 0.3]), (30_000, thump)]
    limits = I.Limits(48_000, 8.0)
    found = I.impulse_events(signal(spark, pulses), limits).orderBy("start").toPandas()
    for at, shape in pulses:
        hit = found[(found.start <= at + len(shape) // 2) & (found.end > at + len(shape) // 2)]
        assert len(hit) == 1, (at, found)
    assert found[found.start < 20_000].kind.tolist() == ["click", "click"]
    assert found[found.start > 20_000].kind.tolist() == ["pop"]
    assert I.impulse_events(signal(spark, []), limits).count() == 0


def test_pieces_of_a_long_run_keep_the_most_severe(spark):
    limits = I.Limits(1000, 10.0, 2.0, 10.0)
    rows = [
        (0, 0, 10, 12, 0.5, 0.3), (0, 0, 12, 15, 0.7, 0.2),                                # united: 5 samples, a pop
        (0, 0, 100, 108, 0.5, 0.3), (0, 0, 107, 116, 0.6, 0.9), (0, 0, 117, 118, 0.4, 0.1),  # too long: two pieces
        (0, 1, 13, 14, 0.9, 0.4), (1, 0, 16, 17, 0.9, 0.4),
    ]
    events = spark.createDataFrame(rows, "rec_id long, ch long, start long, end long, confidence double, severity double")
    got = {tuple(r) for r in I.merge_impulses(events, limits).select("rec_id", "ch", "start", "end", "kind", "severity", "merged").collect()}
    assert got == {
        (0, 0, 10, 15, "pop", 0.3, 2), (0, 0, 107, 116, "pop", 0.9, 2), (0, 0, 117, 118, "click", 0.1, 1),
        (0, 1, 13, 14, "click", 0.4, 1), (1, 0, 16, 17, "click", 0.4, 1)}
    assert I.merge_impulses(events.filter(F.lit(False)), limits).count() == 0


def test_positions_made_of_spans_are_never_broadcast(spark):
    from phonolake.operators.detect import score_impulses

    samples = spark.range(200).selectExpr("1L AS rec_id", "0L AS ch", "id AS n", "sin(id) AS v", "0.1 AS reference", "0.2 AS rms")
    spans = spark.createDataFrame([(1, 0, 50, 52)], "rec_id long, ch long, start long, end long")
    for frame in (score_impulses(spans, samples, 1000), I.loud_spans(samples, samples, I.Limits(1000))):
        assert "strategy=merge" in frame._jdf.queryExecution().optimizedPlan().toString()


def test_samples_are_marked_slice_by_slice(spark, monkeypatch):
    """Short slices, a missing sample and an unfinished block give what one slice gives; levels are those of plain medians."""
    limits = I.Limits(1000, 10.0, 2.0, 10.0)
    v = 0.05 * np.random.default_rng(3).uniform(-1, 1, 6_013)
    for at in (0, 249, 1_260, 2_499, 2_500, 3_740, 6_012):
        v[at] += 0.7
    v[4_004] = np.nan
    frame = pd.DataFrame({"rec_id": 1, "ch": 0, "n": np.arange(len(v)), "v": v})
    samples = spark.createDataFrame(frame).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    whole = {tuple(r) for r in I.marked_samples(samples, limits).collect()}
    events = {tuple(r) for r in I.impulse_events(samples, limits).collect()}
    monkeypatch.setattr(I, "SLICE", 1_250)
    assert {tuple(r) for r in I.marked_samples(samples, limits).collect()} == whole and len(whole) < len(v) // 3
    assert {tuple(r) for r in I.impulse_events(samples, limits).collect()} == events and events
    x = np.abs(v[1:-1] - (v[:-2] + v[2:]) / 2)
    near, home = slice(1_244, 1_281), slice(1_250, 1_275)
    middle, rms = np.median(x[1_243:1_280]), np.sqrt(np.mean(v[near] ** 2))
    scale = max(1.4826 * np.median(np.abs(x[1_243:1_280] - middle)), 0.25 * middle, 0.0015 * rms, 2e-7)
    at = next(r for r in whole if r[2] == 1_260)
    assert at[4:8] == pytest.approx((x[1_259], middle + 5.5 * scale, max(1.13 * np.median(np.abs(v[home])), 0.5 * rms), rms))
    assert at[8] <= 1_260 <= at[9]
