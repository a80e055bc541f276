"""Word alignment counts as an Arrow-batched function: the inner loop of one pair of texts runs in NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALIGNMENT = T.StructType([T.StructField(n, T.LongType()) for n in ("hits", "substitutions", "deletions", "insertions")])


def align_counts(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int, int]:
    """(hits, substitutions, deletions, insertions) of a cheapest alignment; among those, most hits.

    For fixed lengths and cost the number of substitutions decides everything, so edit cost and substitutions are
    minimised together as one weighted distance. A row needs only the one before it, whatever the text length.
    """
    n, m = len(reference), len(hypothesis)
    codes: dict[str, int] = {}
    ref = [codes.setdefault(w, len(codes)) for w in reference]
    hyp = np.array([codes.setdefault(w, len(codes)) for w in hypothesis], dtype=np.int64)
    edit = np.int64(n + m + 1)
    steps = np.arange(m + 1, dtype=np.int64) * edit
    row = steps.copy()
    for word in ref:
        best = np.empty_like(row)
        best[0] = row[0] + edit
        np.minimum(row[1:] + edit, row[:-1] + np.where(hyp == word, 0, edit + 1), out=best[1:])
        row = np.minimum.accumulate(best - steps) + steps
    cost, substitutions = divmod(int(row[m]), int(edit))
    insertions = (cost - substitutions - (n - m)) // 2
    deletions = insertions + n - m
    return n - substitutions - deletions, substitutions, deletions, insertions


@F.pandas_udf(ALIGNMENT)
def align(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    counts = [align_counts(list(r), list(h)) for r, h in zip(reference, hypothesis)]
    return pd.DataFrame(counts, columns=["hits", "substitutions", "deletions", "insertions"], dtype="int64")


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a whole row of the table held in one integer."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for word in b:
        hit = row & places.get(word, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.LongType())
def common_words(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_subsequence(list(x), list(y)) for x, y in zip(a, b)], dtype="int64")
