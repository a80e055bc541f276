"""Elias-Fano against sorted arrays, the trie against counters."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from phonolake.llm import ngram_trie as N
from phonolake.llm import queries as Q
from phonolake.llm.elias_fano import EliasFano, encode


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1), (5, 5), (1000, 1200), (1000, 10**15), (50_000, 2**63 - 1)])
def test_successor_and_access(n, universe):
    rng = np.random.default_rng(n)
    values = np.arange(n) if n == universe else np.unique(rng.integers(0, universe, n))
    coded = EliasFano(encode(values, universe))
    asked = rng.integers(0, universe, 3000)
    assert (coded.successor(asked) == np.searchsorted(values, asked)).all()
    assert (coded.find(values) == np.arange(len(values))).all()
    if len(values):
        assert (coded.access(np.arange(len(values))) == values).all()


def test_dense_stretch_in_a_wide_universe():
    values = np.concatenate([np.arange(40_000), [10**14]])
    assert (EliasFano(encode(values, 10**14 + 1)).find(values) == np.arange(len(values))).all()


def test_packing_of_counts():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**62, 1000).astype(np.uint64))
    assert (N.unpack(N.pack(keys)) == keys).all()
    assert (N.unpack_counts(N.pack_counts(np.arange(9))) == np.arange(9)).all()


def plain(rows, order):
    tokens = [(d, (t or "").encode().lower().split() + [b""]) for d, t in rows]
    counts = [Counter() for _ in range(order + 1)]
    for d, w in tokens:
        if d is not None and zlib.crc32(str(d).encode()) % 10:
            counts[1].update(w)
            x = [b"", *w]
            for k in range(2, order + 1):
                counts[k].update(tuple(x[j - k + 1:j + 1]) for j in range(max(1, k - 1), len(x)))
    total, kinds = ([Counter() for _ in range(order + 1)] for _ in range(2))
    for k in range(2, order + 1):
        for gram, c in counts[k].items():
            total[k][gram[:-1]] += c
            kinds[k][gram[:-1]] += 1
    n, v = sum(counts[1].values()), len(counts[1])
    out = []
    for d, w in tokens:
        base = full = 0.0
        x = [b"", *w]
        for j in range(1, len(x)):
            p = (counts[1][x[j]] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                h = tuple(x[j - k + 1:j])
                if j - k + 1 < 0 or not total[k][h]:
                    break
                p = (max(counts[k][*h, x[j]] - N.DISCOUNT, 0) + N.DISCOUNT * kinds[k][h] * p) / total[k][h]
            full += math.log10(p)
        out.append((str(d), len(w), sum(counts[1][t] > 0 for t in w), n, base, full))
    return sorted(out)


@pytest.mark.parametrize("order, shard_bytes", [(1, 1 << 20), (2, 2000), (3, 5000)])
def test_scores(documents, order, shard_bytes, monkeypatch):
    monkeypatch.setattr(N, "TOKENS_AT_ONCE", 500)
    monkeypatch.setattr(N, "WORDS_KEPT", 50)
    docs = documents.select("doc_id", "text")
    bucket = "coalesce(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 10, 0) = 0"
    docs = docs.selectExpr("doc_id", f"{bucket} AS held_out", "text")
    got = N.score(docs, N.train(docs.filter("NOT held_out"), order, shard_bytes=shard_bytes)).collect()
    want = plain([(r.doc_id, r.text) for r in docs.collect()], order)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4]) and abs(g[5] - w[5]) <= 2e-4 * g[1] + 1e-9


def test_query_scores_with_two_words_of_context(spark, documents, tmp_path):
    documents.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in Q.op6_ngram_trie(spark, str(tmp_path)).collect())
    close = lambda order: [abs(g[2] - w[5]) <= 2e-4 * g[1] + 1e-9 for g, w in zip(got, plain(rows, order), strict=True)]
    assert all(close(3)) and not all(close(2))


def test_level_probabilities_sum_to_one():
    """Shares of a context and the weight it leaves to the level below."""
    context, word, count = np.array([0, 0, 3, 3, 3]), np.array([1, 4, 0, 2, 9]), np.array([3, 1, 2, 2, 1])
    a = N.level_arrays(context, word, count, 0.75)
    sums = np.add.reduceat(N.shares(a["share"]), [0, 2]) + N.shares(a["weight"])
    assert np.allclose(sums, 1, atol=2e-3)


def test_empty_tables(nothing, documents):
    assert N.train_and_score(nothing).count() == 0
    untrained = documents.selectExpr("CAST(NULL AS LONG) AS doc_id", "text")
    assert {r.n_known for r in N.train_and_score(untrained).collect()} == {0}


def test_find_in_large_buckets_and_beyond_the_end():
    """Runs of neighbours longer than are compared one by one, and numbers past the last."""
    values = np.concatenate([np.arange(100, 400), np.arange(2**40, 2**40 + 70), [2**41]])
    coded = EliasFano(encode(values, 2**41 + 1))
    asked = np.concatenate([np.arange(0, 500), np.arange(2**40 - 5, 2**40 + 80), [2**41 - 1, 2**41, 2**41 + 1, 2**60]])
    where = {v: i for i, v in enumerate(values.tolist())}
    assert coded.find(asked).tolist() == [where.get(a, -1) for a in asked.tolist()]


def test_texts_are_cut_into_words_twice_and_contexts_once_a_shard(documents):
    """Numbers are written once: levels and scores read no text. A level holds no second sequence of its contexts."""
    docs = documents.selectExpr("doc_id", "false AS held_out", "text").limit(40)
    plan = N.train_words(docs, 2000)
    texts = N.numbered(docs, plan)
    assert texts.columns == ["doc_id", "held_out", "numbers"]
    plan = N.train_levels(texts.localCheckpoint(), plan, 3)
    level = N.Level(plan["folder"], 3, plan["levels"][1], sum(s["n"] for s in plan["words"]))
    arrays = N.load(plan["folder"], f"grams3-{level.shards[0]['shard']}")
    assert {k.split(".")[0] for k in arrays} == {"ids", "share", "weight"}
    got = sorted(map(repr, N.score_numbered(texts, plan).collect()))
    assert got == sorted(map(repr, N.score(docs, N.train(docs, 3, shard_bytes=2000)).collect()))
