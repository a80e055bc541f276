"""Quality rules: gradient-boosted trees over document statistics, scored from flat node arrays.

The trees are fitted on a bounded, hash-ordered sample of labelled rows (``train_rows``); statistics and verdicts cover
every row and the whole text. Constrained features can only pull the score one way: more symbols, repeated lines or
repeated words never make a document look better.

Edge cases: a null or empty text has zero counts and fails the base rule; labels of only one class, or none, give no
model, and the base rule alone decides; rows that repeat get one verdict each; columns of the input that bear the names
used here stay untouched, because the input row travels as one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonolake.llm.text_stats import STAT_NAMES, doc_stats

FEATURES = (
    "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "punctuation", "variety",
    "line_words",
)
#: -1: the score never rises with the feature; 0: free.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1}
STATS = T.StructType([T.StructField(n, T.LongType(), False) for n in STAT_NAMES])


@F.pandas_udf(STATS)
def text_statistics(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([doc_stats(t) for t in text], columns=list(STAT_NAMES))


def features(stats: np.ndarray) -> np.ndarray:
    """Feature rows from statistics rows (columns in the order of STAT_NAMES)."""
    words, chars, symbols, dup, repeat, lines, upper, digits, punct, distinct = stats.astype(float).T
    w, c, n = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.column_stack([
        chars / w, symbols / c, dup / n, repeat / w, upper / c, digits / c, punct / c,
        np.log1p(distinct) / np.log1p(w),  # less bound to the length than distinct / words
        np.log1p(words / n),
    ])


@dataclass
class Forest:
    """All trees in one set of arrays: a leaf points at itself, so every row walks ``depth`` steps without a branch."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(go_left, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _best_split(grad, hess, direction, low, high, l2, least):
    """Best cut of one node from its per-feature histograms, among cuts that keep to the constraints."""
    gl, hl = grad.cumsum(axis=1)[:, :-1], hess.cumsum(axis=1)[:, :-1]
    g, h = grad.sum(axis=1, keepdims=True), hess.sum(axis=1, keepdims=True)
    gr, hr = g - gl, h - hl
    vl = np.clip(-gl / (hl + l2), low, high)
    vr = np.clip(-gr / (hr + l2), low, high)
    gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - (gr * vr + 0.5 * (hr + l2) * vr**2)
    v = np.clip(-g / (h + l2), low, high)
    gain += g * v + 0.5 * (h + l2) * v**2
    wrong = (direction[:, None] * (vr - vl)) < 0
    gain[wrong | (hl < least) | (hr < least)] = -np.inf
    f, cut = np.unravel_index(np.argmax(gain), gain.shape)
    return gain[f, cut], int(f), int(cut), vl[f, cut], vr[f, cut]


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[str, int] = MONOTONE, trees: int = 40, depth: int = 4,
        rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Forest | None:
    """Boosted trees for log-odds of ``y``; None where only one class is there. ``least``: smallest hessian of a leaf."""
    if len(y) == 0 or y.min() == y.max():
        return None
    direction = np.array([monotone.get(n, 0) for n in FEATURES])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        at = len(value)
        feature.append(0), threshold.append(np.inf), left.append(at), right.append(at), value.append(v)
        return at

    offsets = np.arange(x.shape[1]) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(leaf(0.0))
        open_nodes = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while open_nodes:
            at, rows, level, low, high = open_nodes.pop()
            value[at] = rate * float(np.clip(-grad[rows].sum() / (hess[rows].sum() + l2), low, high))
            if level < depth:
                flat = (binned[rows] + offsets).ravel()
                shape = (x.shape[1], bins)
                g = np.bincount(flat, np.repeat(grad[rows], x.shape[1]), bins * x.shape[1]).reshape(shape)
                h = np.bincount(flat, np.repeat(hess[rows], x.shape[1]), bins * x.shape[1]).reshape(shape)
                gain, f, cut, vl, vr = _best_split(g, h, direction, low, high, l2, least)
                if gain > 1e-6 and cut < len(edges[f]):
                    feature[at], threshold[at] = f, float(edges[f][cut])
                    left[at], right[at] = leaf(0.0), leaf(0.0)
                    middle, d = (vl + vr) / 2, direction[f]
                    below = (low, high) if d == 0 else (low, middle) if d > 0 else (middle, high)
                    above = (low, high) if d == 0 else (middle, high) if d > 0 else (low, middle)
                    goes = binned[rows, f] <= cut
                    open_nodes.append((left[at], rows[goes], level + 1, *below))
                    open_nodes.append((right[at], rows[~goes], level + 1, *above))
                    continue
            margin[rows] += value[at]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value),
                  np.array(roots), depth, base)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000) -> Forest | None:
    """Fit on at most ``train_rows`` labelled documents, taken in hash order of their id."""
    chosen = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    rows = (
        docs.select(F.col("doc_id"), F.col("text").alias("_text"))
        .join(F.broadcast(chosen), "doc_id")  # at most train_rows rows of two numbers
        .select("doc_id", "_label", text_statistics("_text").alias("s"))
        .select("doc_id", "_label", "s.*")
        .toPandas().sort_values(["doc_id", *STAT_NAMES])
    )
    return fit(features(rows[list(STAT_NAMES)].to_numpy()), rows["_label"].to_numpy(float))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


#: Losing a good document counts four times as much as keeping a bad one, so a row goes below 1 / (1 + 4).
THRESHOLD = 0.2


def judged(docs: DataFrame, model: Forest | None, threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (the input row as a struct), ``stats``, ``base_failed``, ``score`` and ``kept``, for every row."""

    @F.pandas_udf("double")
    def score(stats: pd.DataFrame) -> pd.Series:
        return pd.Series(model.score(features(stats[list(STAT_NAMES)].to_numpy())))

    out = docs.select(F.struct("*").alias("row")).withColumn("stats", text_statistics("row.text"))
    out = out.withColumn("base_failed", base_failed(F.col("stats")))
    out = out.withColumn("score", score("stats") if model else F.lit(None).cast("double"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("score", F.lit(1.0)) >= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000,
                  threshold: float = THRESHOLD) -> DataFrame:
    return judged(docs, train(docs, labels, train_rows), threshold)
