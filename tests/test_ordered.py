"""Sliced windows, islands and quantiles against brute force, with borders falling inside the data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolake.operators.ordered import islands, ordinals, over_halo, previous_row, running, slice_no
from phonolake.operators.quantiles import exact_quantiles, quantiles_of


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_running_equals_plain_window(spark):
    rng = random.Random(1)
    data = [(k, t, rng.randint(-9, 9) if rng.random() < 0.8 else None) for k in (0, 1) for t in rng.sample(range(500), 120)]
    df = spark.createDataFrame(data, "k long, t long, x long")
    specs = {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("x"))}
    for reverse in (False, True):
        for inclusive in (False, True):
            got = rows(running(df, ["k"], slice_no("t", 16), ["t"], specs, inclusive, reverse), "k", "t", "s", "m", "l")
            want = []
            for k in (0, 1):
                seen = []
                for _, t, x in sorted((r for r in data if r[0] == k), key=lambda r: -r[1] if reverse else r[1]):
                    shown = [*seen, x] if inclusive else seen
                    known = [v for v in shown if v is not None]
                    want.append((k, t, sum(known), max(known, default=None), known[-1] if known else None))
                    seen.append(x)
            assert got == sorted(want)


def test_previous_row_crosses_empty_slices(spark):
    df = spark.createDataFrame([(1, 3), (1, 900), (1, 901), (2, 5)], "k long, t long")
    got = rows(previous_row(df, ["k"], slice_no("t", 10), ["t"], ["t"]), "k", "t", "prev_t")
    assert got == [(1, 3, None), (1, 900, 3), (1, 901, 900), (2, 5, None)]


def test_ordinals_with_one_hot_key(spark):
    rng = random.Random(2)
    data = [(0 if rng.random() < 0.9 else 1, rng.randint(0, 50), i) for i in range(400)]
    df = spark.createDataFrame(data, "k long, t long, id long")
    got = {(r.k, r.id): r.n for r in ordinals(df, ["k"], {"_s": slice_no("t", 5)}, [F.col("t"), F.col("id")]).collect()}
    for k in (0, 1):
        order = sorted((t, i) for key, t, i in data if key == k)
        assert [got[(k, i)] for _, i in order] == list(range(len(order)))


@pytest.mark.parametrize("gap", [0, 1, 3])
def test_islands_join_over_slice_borders(spark, gap):
    rng = random.Random(gap)
    members = sorted(n for n in range(600) if rng.random() < 0.6)
    df = spark.createDataFrame([(1, n) for n in members], "k long, n long")
    got = rows(islands(df, ["k"], "n", {"c": ("sum", F.lit(1))}, gap=gap, size=16), "start", "last", "c")
    want, run = [], [members[0]]
    for n in members[1:]:
        if n - run[-1] <= gap + 1:
            run.append(n)
        else:
            want.append((run[0], run[-1], len(run)))
            run = [n]
    assert got == sorted([*want, (run[0], run[-1], len(run))])


def test_halo_window_sees_neighbours(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("n"))
    out = over_halo(df, ["k"], "n", {"s": lambda w: F.sum("n").over(w.rowsBetween(-3, 2))}, before=3, after=2, size=8)
    assert [r.s for r in out.orderBy("n").collect()] == [sum(range(max(0, i - 3), min(99, i + 2) + 1)) for i in range(100)]


def test_quantile_rules(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=500), np.repeat(1.25, 300)])
    df = spark.createDataFrame([(1, float(v)) for v in values], "k long, v double")
    wanted = {"a": ("linear", 0.1), "b": ("nearest", 0.95), "c": ("floor", 0.75), "d": ("index", 0.9995)}
    got = exact_quantiles(df, ["k"], "v", wanted).first()
    s, n = np.sort(values), len(values)
    assert math.isclose(got.a, np.quantile(values, 0.1), abs_tol=1e-12)
    assert got.b == s[int((n - 1) * 0.95 + 0.5)]
    assert got.c == s[int((n - 1) * 0.75)]
    assert got.d == s[int(n * 0.9995)]
    both = quantiles_of(df.withColumn("w", -F.col("v")), ["k"], ["v", "w"], "linear", 0.5).first()
    assert math.isclose(both.m_v, -both.m_w)


def test_quantile_with_infinities_and_no_key(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (None,)], "v double")
    got = exact_quantiles(df, [], "v", {"lo": ("floor", 0.0), "hi": ("floor", 1.0)}).first()
    assert got.lo == float("-inf") and got.hi == 2.0
