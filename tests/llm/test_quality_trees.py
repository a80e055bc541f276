"""Statistics against plain counting, the trees against a walk node by node, and their constraints."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phonolake.llm import quality_trees as Q
from phonolake.llm.text_stats import STAT_NAMES, doc_stats


def plain(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="ab é\n\t|#\x0b  Z1", max_size=80)))
def test_counts(text):
    if text and not text.strip(" \t\n\x0b\x0c\r"):
        assert doc_stats(text)[0] == 0
    else:
        assert doc_stats(text)[:5] == plain(text)


def test_many_distinct_words_still_count_exactly():
    from phonolake.llm.text_stats import repeated_words

    ids = np.arange(30)
    ids[20:25] = ids[3:8]
    assert repeated_words(ids, 30) == repeated_words(ids, 3_000_000) == 10


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    x = rng.random((3000, len(Q.FEATURES)))
    y = (x[:, 1] + 0.5 * np.sin(6 * x[:, 0]) + 0.1 * rng.normal(size=3000) < 0.6).astype(float)
    return x, y


def test_flat_arrays_score_like_a_walk_down_the_nodes(sample):
    x, y = sample
    forest = Q.fit(x[:2000], y[:2000], trees=10)
    for row, margin in zip(x[2000:2100], forest.margin(x[2000:2100])):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert np.isclose(total, margin)
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_constrained_features_pull_one_way(sample):
    x, y = sample
    forest = Q.fit(x, y)
    for name, way in Q.MONOTONE.items():
        probe = np.repeat(x[:50], 40, axis=0)
        probe[:, Q.FEATURES.index(name)] = np.tile(np.linspace(-0.1, 1.1, 40), 50)
        steps = np.diff(forest.margin(probe).reshape(50, 40), axis=1) * way
        assert (steps >= -1e-9).all()


def test_every_row_gets_a_verdict(spark, documents, nothing):
    labels = spark.createDataFrame([(1, 1), (9, 0), (3, 1), (12, 1), (None, 1), (7, None), (99, 0)], "doc_id long, quality int")
    rows = Q.quality_rules(documents, labels).select("row.doc_id", "row.text", "stats", "base_failed", "kept").collect()
    assert len(rows) == documents.count()
    for r in rows:
        if not (r.text and not r.text.strip()):
            assert tuple(r.stats[n] for n in STAT_NAMES[:5]) == plain(r.text)
        words, repeats = r.stats["n_words"], r.stats["n_repeat_words"]
        assert r.base_failed == (words < 50 or 100 * repeats > 50 * words)
        assert not (r.base_failed and r.kept)
    assert Q.quality_rules(nothing, labels).count() == 0
    one_class = Q.quality_rules(documents, labels.filter("quality = 1")).select("base_failed", "kept").collect()
    assert all(r.kept != r.base_failed for r in one_class)
