"""Split choices against enumeration, combined in rounds, and the sweep over settings."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from phonolake.operators import splits as L

LENGTH = 100


def choices(at, weight, apart):
    for k in range(len(at) + 1):
        for c in combinations(range(len(at)), k):
            if all(at[b] - at[a] >= apart for a, b in zip(c, c[1:])):
                yield k, sum(weight[i] for i in c), [at[i] for i in reversed(c)]


def best(found):
    """The heaviest; of equal ones that with the earliest latest split."""
    return min(((-w, kept) for _, w, kept in found), default=None)


def sides(seed, many):
    """Positions with few distinct weights, so that ties are common."""
    rng = random.Random(seed)
    for side in range(many):
        at = sorted(rng.sample(range(12, 88), rng.randint(0, 8)))
        yield side, at, [2 * rng.randint(1, 4) for _ in at]


def test_profiles_against_enumeration():
    for _, at, weight in sides(6, 60):
        found = list(choices(at, weight, 12))
        got = L.profile(at, weight, 12, 5)
        assert set(got) == {k for k, _, _ in found if k <= 5}
        for k, (w, kept) in got.items():
            assert (-w, kept) == best([c for c in found if c[0] == k])
        total, kept = L.heaviest(at, weight, 12)
        assert (-total, kept[::-1]) == best(found)


def test_combined_profiles_equal_the_whole():
    rng = random.Random(7)
    for _ in range(30):
        parts = [(sorted(rng.sample(range(40 * i, 40 * i + 20), 3)), [rng.randint(1, 3) for _ in range(3)]) for i in range(4)]
        whole = L.profile(sum((p for p, _ in parts), []), sum((w for _, w in parts), []), 15, 6)
        one, two, three, four = (L.profile(p, w, 15, 6) for p, w in parts)
        assert L.combined(L.combined(one, two, 6), L.combined(three, four, 6), 6) == whole
        assert L.combined(L.combined(L.combined(one, two, 6), three, 6), four, 6) == whole


def tables(spark, data):
    quiet = [(side, -40.0, p - w // 2, p + w // 2) for side, at, weight in data for p, w in zip(at, weight)]
    silences = spark.createDataFrame(quiet, "rec_id long, threshold_db double, start long, end long")
    return silences, spark.createDataFrame([(side, LENGTH) for side, _, _ in data], "rec_id long, frames long")


@pytest.mark.parametrize("tracks", [1, 3, 6])
def test_exact_splits_in_rounds_of_two(spark, monkeypatch, tracks):
    monkeypatch.setattr(L, "FAN", 2)
    data = list(sides(8, 40))
    silences, frames = tables(spark, data)
    got = {r.rec_id: r for r in L.exact_splits(silences, frames, 6, tracks, [-40.0]).collect()}
    assert len(got) == len(data)
    for side, at, weight in data:
        found = list(choices(at, weight, 6))
        counted = [c for c in found if c[0] == tracks - 1]
        want = best(counted or found)[1][::-1]
        assert got[side].boundaries == [0, *want, LENGTH] and got[side].exact == bool(counted)


def test_strongest_splits_answer_where_nothing_is_quiet(spark):
    data = [*sides(9, 20), (99, [], [])]
    silences, frames = tables(spark, data)
    got = {(r.rec_id, r.threshold_db): r.boundaries for r in L.strongest_splits(silences, frames, 6, [-50.0, -40.0]).collect()}
    for side, at, weight in data:
        assert got[side, -50.0] == [0, LENGTH]
        assert got[side, -40.0] == [0, *best(choices(at, weight, 6))[1][::-1], LENGTH]


def test_plateaus_are_held_against_the_first_answer(spark):
    answers = [(1, -40.0, [0, 100, 900]), (1, -39.0, [0, 104, 900]), (1, -38.0, [0, 108, 900]), (1, -37.0, [0, 900]),
               (1, -36.0, [0, 900]), (1, -35.0, [0, 900]), (2, -40.0, [0, 50])]
    rows = L.plateaus(spark.createDataFrame(answers, "rec_id long, threshold_db double, boundaries array<long>"), 5).orderBy("rec_id", "low_db")
    got = [(r.rec_id, r.tracks, r.low_db, r.high_db, r.chosen_db, r.boundaries) for r in rows.collect()]
    assert got == [(1, 2, -40.0, -39.0, -40.0, [0, 100, 900]), (1, 2, -38.0, -38.0, -38.0, [0, 108, 900]),
                   (1, 1, -37.0, -35.0, -36.0, [0, 900]), (2, 1, -40.0, -40.0, -40.0, [0, 50])]


def test_short_gaps_count_only_where_long_ones_find_nothing(spark):
    settings = [float(x) for x in range(-50, -39)]
    quiet = [(1, db, 490, 510) for db in settings] + [(1, db, 200, 204) for db in settings] + [(2, db, 300, 306) for db in settings]
    silences = spark.createDataFrame(quiet, "rec_id long, threshold_db double, start long, end long")
    frames = spark.createDataFrame([(1, 1000), (2, 1000), (3, 1000)], "rec_id long, frames long")
    got = {r.rec_id: (r.boundaries, r.relaxed) for r in L.sweep_tracks(silences, frames, settings, 100, 5, 10).filter("best").collect()}
    assert got == {1: ([0, 500, 1000], False), 2: ([0, 303, 1000], True), 3: ([0, 1000], False)}
    wanted = L.sweep_tracks(silences, frames, settings, 100, 5, 10, tracks=2).filter("best").collect()
    assert {r.rec_id for r in wanted} == {1, 2}


def test_empty_tables(spark):
    silences, frames = tables(spark, [])
    assert L.exact_splits(silences, frames, 6, 3, [-40.0]).count() == 0
    assert L.sweep_tracks(silences, frames, [-40.0], 6, 5, 10).count() == 0


def test_silences_from_a_level_upward_are_answered_as_if_given_per_setting(spark):
    rng = random.Random(26)
    settings = [float(x) for x in range(-50, -40)]
    rows = [(rec, at, at + rng.randrange(4, 30), float(rng.choice((-53, -48, -44.5, -30)))) for rec in range(4) for at in rng.choices(range(20, 900), k=200)]
    frames = spark.createDataFrame([(rec, 1000) for rec in range(5)], "rec_id long, frames long")
    once = spark.createDataFrame(rows, "rec_id long, start long, end long, from_db double")
    each = once.select("rec_id", "start", "end", F.explode(F.filter(F.array(*[F.lit(x) for x in settings]), lambda x: x >= F.col("from_db"))).alias("threshold_db"))
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    assert plain(L.strongest_splits(once, frames, 40, settings)) == plain(L.strongest_splits(each, frames, 40, settings))
    assert plain(L.exact_splits(once, frames, 40, 5, settings)) == plain(L.exact_splits(each, frames, 40, 5, settings))
    a, b = (L.sweep_tracks(x, frames, settings, 40, 5, 20, tracks=5) for x in (once, each))
    assert plain(a.select(sorted(a.columns))) == plain(b.select(sorted(b.columns)))


def test_candidates_do_not_grow_with_silences_at_one_place(spark):
    frames = spark.createDataFrame([(1, 1000)], "rec_id long, frames long")
    silences = spark.range(5000).select(F.lit(1).cast("long").alias("rec_id"), (500 - F.col("id") % 40).alias("start"), (500 + F.col("id") % 40).alias("end"), F.lit(-48.0).alias("from_db"))
    candidates, asked = L._posed(silences, frames, 40, [-50.0, -48.0, -45.0])
    assert [tuple(r) for r in candidates.collect()] == [(1, -48.0, 500, 78)]
    assert sorted((r.threshold_db, r._solved) for r in asked.collect()) == [(-50.0, None), (-48.0, -48.0), (-45.0, -48.0)]
