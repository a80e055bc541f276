"""Targets against filling by hand; the mix against its constraints."""

import random

import pytest
from pyspark.sql import functions as F

from phonolake.llm import mixing as M


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": rng.choice([1, 10, 500, 3000]) * rng.randint(1, 9) for i in range(rng.randint(1, 12))}
    sizes[None] = rng.randint(0, 4000)
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None]), " ".join(["w"] * int(rng.paretovariate(0.9) * 20 % 5000))) for i in range(3000)]
    path = str(tmp_path / "mix.parquet")
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(path)
    return spark.read.parquet(path)


def test_each_source_comes_near_its_target(corpus):
    rows = M.mix(corpus).collect()
    assert len(rows) == 3000 and all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in rows)
    sources = {}
    for r in rows:
        s = sources.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.taken
        s[1] += r.size
    want = filled({k: v[1] for k, v in sources.items()})
    for source, (taken, size, target, said) in sources.items():
        assert size == said and target == pytest.approx(want[source])
        assert abs(taken - target) <= max(2, 0.001 * target)


def test_rates_are_exponential_in_size_and_meet_the_dual(corpus):
    rows = M.mix(corpus).toPandas()
    for _, g in rows[rows["size"] > 0].groupby("source", dropna=False):
        assert (g["rate"] * g["size"]).sum() == pytest.approx(g["target"].iloc[0], rel=1e-6)
        inner = g[(g["rate"] < 2) & (g["rate"] != 1)]
        if len(inner) > 1:
            import numpy as np

            slope = np.log(inner["rate"]) / inner["size"]
            assert slope.max() == pytest.approx(slope.min(), abs=1e-9)


@pytest.mark.parametrize("share", [1.15, 1.5])
def test_rows_that_draw_alike_are_taken_one_by_one(spark, tmp_path, share):
    """Null and repeated ids of equal sizes: every source comes within one document of its target."""
    words = "w " * 100
    rows = [(None, "a", words)] * 2000 + [(7, "b", words)] * 1500 + [(i % 3, None, words) for i in range(900)] + [(i, "c", words) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5).write.parquet(path := str(tmp_path / "alike.parquet"))
    out = M.mix(spark.read.parquet(path), weights=(1,), share=share).collect()
    for source in {r.source for r in out}:
        mine = [r for r in out if r.source == source]
        assert abs(mine[0].target - sum(r.taken for r in mine)) <= 100, source


def test_columns_of_any_name_pass_through(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a", "w " * 10, "x", "y", "z") for i in range(20)],
                                 "doc_id long, source string, text string, __rid string, __size string, `size` string")
    docs.write.parquet(path := str(tmp_path / "names.parquet"))
    docs = spark.read.parquet(path)
    out = M.decided(docs, *M.solution(docs)).select("row.*")
    assert out.columns == docs.columns and {(r["__rid"], r["__size"], r["size"]) for r in out.collect()} == {("x", "y", "z")}


def test_the_walk_is_the_rule_row_by_row(spark, tmp_path):
    """Copies against walking each source's rows in key order by hand, passing over what does not fit."""
    rng = random.Random(8)
    rows = [(i, rng.choice("abc"), " ".join(["w"] * rng.choice([0, 3, 40, 41, 900]))) for i in range(800)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(path := str(tmp_path / "walk.parquet"))
    docs = spark.read.parquet(path)
    plan, chosen = M.solution(docs)
    placed = docs.select(F.monotonically_increasing_id().alias("__rid"), "doc_id", "source", M.word_count(F.col("text")).alias("__size"))
    keyed = M._drawn(M._with_source(placed, plan), 2).withColumn("__walked", M._copies(2)).collect()
    for source in "abc":
        mine = sorted((r for r in keyed if r.source == source), key=lambda r: r["__key"])
        gap = int(mine[0]["__target"] + 0.5) - sum(int(r["__floor"]) * r["__size"] for r in mine)
        for r in mine:
            fits = r["__floor"] < 2 and 0 < r["__size"] <= gap
            assert r["__walked"] == r["__floor"] + fits, (source, r)
            gap -= r["__size"] * fits


def test_reruns_agree(corpus):
    key = lambda df: sorted(map(str, df.select("doc_id", "source", "size", "copies", "taken").collect()))
    assert key(M.mix(corpus)) == key(M.mix(corpus))


def test_edge_cases(stable, nothing):
    rows = M.mix(stable).collect()
    assert len(rows) == stable.count()
    assert all(r.taken == 0 and r.size == 0 for r in rows if r.doc_id in (4, 5, 6))
    assert M.mix(nothing).count() == 0
    silent = stable.withColumn("text", F.lit(None).cast("string"))
    assert [r.taken for r in M.mix(silent).collect()] == [0] * stable.count()


@pytest.mark.parametrize("seed", range(3))
def test_one_long_document_does_not_shut_out_the_small_ones(spark, tmp_path, seed):
    """Sources of one document with 30 % of the words and 700 of 50 words each; targets are 1.15 times the size."""
    small = [(1000 * seed + i, "b", "w " * 50) for i in range(700)]
    rows = small + [(-(10 * seed + k), f"b{k}", "w " * 15_000) for k in range(1, 9)]
    rows += [(5000 + 1000 * k + i, f"b{k}", "w " * 50) for k in range(1, 9) for i in range(700)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(path := str(tmp_path / "lump.parquet"))
    out = M.mix(spark.read.parquet(path), weights=(1,), share=1.15).collect()
    for source in {r.source for r in out}:
        mine = [r for r in out if r.source == source]
        left = mine[0].target - sum(r.taken for r in mine)
        assert -0.5 <= left < 50 + 0.5, (source, left)
