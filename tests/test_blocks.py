"""The block record, filtered and summed slice by slice, and plateaus without a second look at the samples."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phonolake.operators import blocks as B
from phonolake.operators import segments as G

RATE, TAPS = 1000, [0.5, -0.3, -0.2, 0.05]


def signal(spark, size=2_530):
    n = np.arange(size)
    rng = np.random.default_rng(5)
    left, right = np.sin(n / 3) * (1 + n % 700) / 800, rng.uniform(-0.5, 0.5, size)
    left[40], right[1_200:1_300], left[1_700:1_800] = 1.0, 0.0, np.nan
    parts = [pd.DataFrame({"rec_id": 3, "ch": ch, "n": n, "v": v}) for ch, v in ((0, left), (1, right))]
    return left, right, spark.createDataFrame(pd.concat(parts)).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


def test_blocks_are_summed_in_one_pass_whatever_the_slices(spark, monkeypatch):
    left, right, samples = signal(spark)
    whole = B.block_summary(samples, RATE, TAPS)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapGroupsInPandas") == 1
    whole = whole.orderBy("block").toPandas()
    monkeypatch.setattr(B, "SLICE", 300)
    pd.testing.assert_frame_equal(B.block_summary(samples, RATE, TAPS).orderBy("block").toPandas(), whole)
    assert whole.block.tolist() == list(range(26)) and whole.frames.tolist() == [100] * 25 + [30]
    a = [np.convolve(np.nan_to_num(x), TAPS)[:len(x)] for x in (left, right)]
    crossings = [np.concatenate([[0], np.sign(x[1:]) * np.sign(x[:-1]) < 0]) for x in a]
    for k in (0, 7, 12, 17, 25):
        at = slice(100 * k, 100 * k + 100)
        l, r, row = left[at], right[at], whole.iloc[k]
        power = np.nansum(l * l) + np.nansum(r * r)
        assert row.rms_db == pytest.approx(10 * np.log10(power / (2 * len(l))))
        assert row.activity_rms_db == pytest.approx(10 * np.log10(sum((x[at] ** 2).sum() for x in a) / (2 * len(l))))
        assert row.zc_per_s == pytest.approx(max(c[at].sum() for c in crossings) * RATE / len(l))
        heard = np.abs(np.concatenate([l, r]))
        bins = np.sort(np.clip(np.floor(-20 * np.log10(heard[heard > 1e-9]) / 0.5), 0, 127))
        assert row.trimmed_peak_db == -(bins[max(1, int(2 * len(l) * 0.005)) - 1] + 0.5) * 0.5
    assert np.isnan(whole.left_ms[17]) and whole.clipped[0] == 1
    alone = {r.block: r.trimmed_peak_db for r in B.trimmed_peak(samples, 100).collect()}
    assert alone == dict(zip(whole.block, whole.trimmed_peak_db))


def test_plateaus_know_their_slopes_also_at_slice_borders_and_ends(spark):
    v = 0.01 * np.sin(np.arange(65_700.0))
    for at, size in ((0, 4), (100, 5), (65_534, 4), (65_600, 3), (65_696, 4)):
        v[at:at + size] = 0.5
    v[202:206], v[201] = 0.5, 0.5 - 0.0004  # no slope in
    samples = spark.createDataFrame(pd.DataFrame({"rec_id": 1, "ch": 0, "n": np.arange(len(v)), "v": v}))
    tops = G.flat_tops(samples)
    assert "Join" not in tops._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.start, r.end) for r in tops.collect()) == [(100, 105), (65_534, 65_538), (65_600, 65_603)]


def test_pyramid_levels_are_means_of_the_level_below(spark):
    import random

    from phonolake.operators import signal as S

    rng, sizes, want = random.Random(7), {1: 64 * 300 - 20, 2: 64 * 64, 3: 10}, {}
    rows = [(r, 0, n, None if r == 3 and n == 4 else round(rng.uniform(-1, 1), 2) / 0.7) for r, size in sizes.items() for n in range(size)]

    def mean(values):
        total = 0.0
        for x in values:
            total += x
        return total / len(values)

    for r in sizes:
        level = {}
        for _, _, n, v in (x for x in rows if x[0] == r and x[3] is not None):
            level.setdefault(n // 64, []).append(v * v)
        level, k = {b: mean(v) for b, v in level.items()}, 0
        want |= {(r, k, b): m for b, m in level.items()}
        while len(level) > 64:
            above = {}
            for b, m in sorted(level.items()):
                above.setdefault(b // 4, []).append(m)
            level, k = {b: mean(v) for b, v in above.items()}, k + 1
            want |= {(r, k, b): m for b, m in level.items()}
    table = spark.createDataFrame(rows, "rec_id long, ch long, n long, v double").repartition(7)
    got = S.pyramid(table).collect()
    assert len(got) == len(want) and {(r.rec_id, r.level, r.bin): r.ms for r in got} == want  # to the last bit
    assert {k for _, k, _ in want} == {0, 1, 2}
    assert S.pyramid(table.limit(0)).count() == 0
