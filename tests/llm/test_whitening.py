"""Whitening against a plain eigendecomposition."""

import numpy as np
import pytest

from phonolake.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, x string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "mine", "mine") for i, v in rows], SCHEMA)


def check(spark, vectors, count=8):
    """Every column against numpy on the same integers."""
    rows = list(enumerate(vectors))
    x = np.floor(1024 * np.array(vectors)).astype(np.int64) + 100_000
    n, dims = x.shape
    centred = x - x.sum(axis=0) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes, count = values[::-1], axes[:, ::-1], min(count, dims)
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0))) for row in x]
    got = W.whiten(table(spark, rows)).collect()
    assert len(got) == n * count
    white = np.full((n, count), np.nan)
    for r in got:
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error <= 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        white[r.vec_id, r.component - 1] = r.whitened
    want = centred @ axes[:, :count] / np.sqrt(values[:count])
    signs = np.sign((white * want).sum(axis=0))
    assert np.abs(white - want * signs).max() < 1e-7
    assert np.abs(np.cov(white.T, bias=True).reshape(count, count) - np.eye(count)).max() < 1e-9


@pytest.mark.parametrize("case", ["even", "steep", "few dims", "close"])
def test_against_eigh(spark, case):
    rng = np.random.default_rng(11)
    if case == "even":
        x = rng.standard_normal((700, 40)) / 6
    elif case == "steep":
        x = rng.standard_normal((400, 50)) * np.exp(-np.arange(50) / 4.0) + 3
    elif case == "few dims":
        x = rng.standard_normal((100, 5)) - 40
    else:
        x = rng.standard_normal((1500, 36)) * np.where(np.arange(36) < 12, 1.02, 1.0)
    check(spark, x.tolist())


def test_passes_are_few(spark):
    """Certified within rounds that a plain power iteration could not do."""
    rng = np.random.default_rng(2)
    rows = W.Rows(W.integers(table(spark, list(enumerate(rng.standard_normal((500, 48)).tolist()))), 1024, 100_000), 100_000)
    passes, times = [], W.Rows.times
    rows.times = lambda block: passes.append(1) or times(rows, block)
    values, axes = W.components(rows, 8)
    assert len(passes) < 80
    assert np.allclose(axes.T @ axes, np.eye(8), atol=1e-13) and (np.diff(values) <= 0).all()


def test_edge_cases(spark):
    rows = [(1, [1, 2]), (1, [1, 2]), (2, None), (3, [None, 1]), (4, [float("nan"), 0]), (5, [float("-inf"), 0]), (None, [3, 1]),
            (6, [2]), (7, []), (8, [1e300, 0])]
    got = W.whiten(table(spark, rows)).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i in (1, 1, None, 6, 7) for _ in range(2))
    assert {r.n for r in got} == {5} and all(r.identity_error < 1e-9 and r.whitened is not None for r in got)
    assert W.whiten(table(spark, [])).count() == 0
    assert W.whiten(table(spark, [(1, []), (2, None)])).count() == 0
    same = W.whiten(table(spark, [(i, [1.5, 2.5, 0]) for i in range(4)])).collect()
    assert len(same) == 12 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 for r in same)
    line = W.whiten(table(spark, [(i, [i, 2 * i, 0]) for i in range(5)])).collect()
    assert [r.whitened is None for r in sorted(line, key=lambda r: (r.vec_id, r.component))] == [False, True, True] * 5
    huge = W.whiten(table(spark, [(1, [1e12]), (2, [0])])).collect()
    assert [r.deviation for r in huge] == [None, None]
