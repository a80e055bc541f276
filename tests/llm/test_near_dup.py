"""Components of the Hamming join against all pairs of sets."""

import random

import numpy as np

from phonolake.llm import near_dup as N
from phonolake.llm.components import components


def plain(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    low = {r: min((d for d in ids if d is not None), default=None) for r, ids in members.items()}
    return sorted(str((rows[i][0], len(sets[i]), low[find(i)])) for i in range(len(rows))), len(members)


def run(docs):
    docs = N.numbered(docs.select("doc_id", "text"))
    got = N.near_groups(docs).collect()
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got), sum(r.rid == r.first_rid for r in got)


def test_edge_cases(stable):
    rows = [(r.doc_id, r.text) for r in stable.select("doc_id", "text").collect()]
    assert run(stable) == plain(rows)


def test_groups_of_edited_copies(spark, tmp_path):
    """A hub whose copies are alike only through it, a chain, a large group of light edits, and pairs at the border."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, n = [], 200
    hub = [word() for _ in range(n)]
    add = lambda w: rows.append((len(rows), " ".join(w)))

    def edited(w, k):
        w = list(w)
        for i in rng.sample(range(len(w)), k):
            w[i] = word()
        return w

    for _ in range(40):
        add(edited(hub, 5))
    add(hub)
    chain = [word() for _ in range(n)]
    for _ in range(15):
        add(chain)
        chain = edited(chain, 4)
    large = [word() for _ in range(n)]
    for _ in range(60):
        add(edited(large, 1))
    for k in range(1, 9):
        pair = [word() for _ in range(100)]
        add(pair), add(edited(pair, k))
    passage = [word() for _ in range(80)]
    for _ in range(40):
        add([word() for _ in range(60)] + passage + [word() for _ in range(60)])
    path = str(tmp_path / "near.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    assert run(spark.read.parquet(path)) == plain(rows)


def test_pigeonhole_finds_every_pair_within_reach():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, N.ROWS).astype("<u2")
        b = a.copy()
        at = rng.choice(N.ROWS, N.REACH, replace=False)
        b[at] += 1
        assert set(N.chunk_keys(a)) & set(N.chunk_keys(b))


def test_overlaps_from_differences():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(0, 900))).astype(np.uint64) for _ in range(20)]
    got = N.shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(20) for j in range(20) if i != j)


def test_small_blocks_give_the_same_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 3)
    test_groups_of_edited_copies(spark, tmp_path)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(30)}}


def test_empty_table(nothing):
    assert run(nothing) == ([], 0)
