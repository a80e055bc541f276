"""The search against brute force: recall, exact scores, order and ties."""

import numpy as np
import pytest

from phonolake.llm import collision_search as C

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, cid string, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "mine", "mine", "mine") for i, v in rows], SCHEMA)


def brute(rows, k=20, every=20):
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and len(v)]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    out = {}
    for q, v in ok:
        if q % every == 0:
            out[q] = sorted(((-float((v * x).sum()), i) for i, x in ok if i != q))[:k]
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    return {q: sorted(hits) for q, hits in out.items()}


@pytest.mark.parametrize("kind", ["even", "clustered", "lengths"])
def test_recall(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 32))
    if kind == "clustered":
        x = rng.standard_normal((30, 32))[rng.integers(0, 30, 3000)] + 0.2 * x
    if kind != "lengths":
        x /= np.linalg.norm(x, axis=1)[:, None]
    else:
        x *= rng.lognormal(0, 0.4, 3000)[:, None]
    rows = list(enumerate(x))
    got, want = answers(C.nearest(table(spark, rows), block=700)), brute(rows)
    assert got.keys() == want.keys()
    caught = 0
    for q, hits in got.items():
        assert [r for r, _, _ in hits] == list(range(1, 21))
        assert [h[1:] for h in hits] == sorted(h[1:] for h in hits)
        caught += len({i for _, _, i in hits} & {i for _, i in want[q]})
        exact = {i: s for s, i in want[q]}
        assert all(s == pytest.approx(exact[i], abs=1e-12) for _, s, i in hits if i in exact)
    assert caught / (20 * len(got)) >= 0.95


def test_repeated_vectors_and_ties_are_exact(spark):
    """A third of the rows hold one vector: results are the smallest ids, and nothing is searched twice."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 8))
    rows = [(i, x[0] if i % 3 == 0 else x[i % 300]) for i in range(900)]
    got, want = answers(C.nearest(table(spark, rows))), brute(rows)
    assert {q: [i for _, _, i in h] for q, h in got.items()} == {q: [i for _, i in h] for q, h in want.items()}


def test_edge_cases(spark):
    rows = [(0, [1, 0]), (1, None), (2, [0, 0]), (3, [1, None]), (4, [float("nan"), 1]), (5, [float("inf"), 0]), (6, [0.5, 0]),
            (7, [2]), (8, []), (None, [1, 1]), (20, [-1, 0]), (20, [-1, 0]), (40, [0, 0]), (9, [1, 0])]
    got = answers(C.nearest(table(spark, rows)))
    assert got == {0: [(1, -2.0, 7), (2, -1.0, 9), (3, -0.5, 6), (4, 1.0, 20)],
                   20: [(1, 0.5, 6), (2, 1.0, 0), (3, 1.0, 9), (4, 2.0, 7)]}
    assert C.nearest(table(spark, [])).count() == 0
    assert C.nearest(table(spark, [(0, [1, 2])])).count() == 0


def test_extreme_radii_end(spark):
    rows = [(i, [1e-3 * (i + 1), 1.0]) for i in range(40)] + [(100, [-1e6, 5.0]), (120, [1e6, 0])]
    got, want = answers(C.nearest(table(spark, rows), k=50)), brute(rows, k=50)
    assert {q: [i for _, _, i in h] for q, h in got.items()} == {q: [i for _, i in h] for q, h in want.items()}


def test_threshold():
    assert C.threshold(128, 1.2) == 91 and C.threshold(1, 0.1) == 1
    axes = C.directions(5, 12)
    assert axes.shape == (12, 5) and np.allclose(axes[:5] @ axes[:5].T, np.eye(5))
