"""Held-out accuracy, and rows that have nothing to learn from."""

import random
import zlib

import pytest

from phonolake.llm import compression_classifier as C


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    good = [w for w in ("river", "stone", "morning", "letter", "window", "garden", "quiet", "paper", "bridge", "winter")]
    bad = [w.upper() + "!!" for w in ("buy", "cheap", "pills", "click", "winner", "casino", "free", "offer")]
    rows = []
    for i in range(600):
        words = good if i % 3 else bad
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(20, 400))), int(bool(i % 3))))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_held_out_accuracy(labelled):
    rows = C.train_and_score(labelled, labelled.selectExpr("doc_id", "label AS quality")).join(labelled, "doc_id").collect()
    assert len(rows) == 600
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.label for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_labels_change_nothing(labelled):
    labels = labelled.selectExpr("doc_id", "label AS quality")
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 1 - quality, quality) AS quality")
    score = lambda x: {r.doc_id: r.score for r in C.train_and_score(labelled, x).collect()}
    assert score(labels) == score(flipped)


def test_edge_cases(spark, documents, nothing, labelled):
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1), (7, None), (12, 1), (99, 0)], "doc_id long, quality int")
    for known in (labels, labels.filter("quality = 1"), labels.limit(0)):
        rows = C.train_and_score(documents, known).collect()
        assert len(rows) == documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert C.train_and_score(nothing, labels).count() == 0
    model = C.train(labelled, labelled.selectExpr("doc_id", "label AS quality"))
    docs = documents.selectExpr("doc_id", "false AS held_out", "text")
    scores = {r.doc_id: r.score for r in C.score(docs, model).collect()}
    assert scores[4] == scores[5] and len(scores) == len({r.doc_id for r in documents.collect()})
