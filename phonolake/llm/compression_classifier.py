"""Quality score from compression: how much better a text packs with a dictionary of good text than with one of bad.

Two zstandard dictionaries are built from labelled text. A text is cut into pieces of ``piece`` bytes, each compressed
with the good, the bad and no dictionary, so a dictionary helps the end of a long text as much as its start. The
difference (bad - good) per byte, with the plain ratio beside it, is calibrated to a probability by logistic regression on
documents that built no dictionary.

Bounds, all parameters: ``train_rows`` documents per class, taken in hash order of their id (every other one for the
dictionaries, the rest for the calibration), and ``train_pieces`` pieces per class in hash order. Every row and whole text
is scored. Labels enter the training only; a score sees nothing but its text.

Edge cases: a null or empty text has a difference and ratio of 0 and the score those give; with labels of one class, or
none, every score is the share of label 1 among them, or one half; repeated rows score alike; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL = 3


def pieces(text: str | None, piece: int) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[at:at + piece] for at in range(0, len(raw), piece)]


class Compressors:
    """Compressed sizes with the good, the bad and no dictionary."""

    def __init__(self, good: bytes, bad: bytes, piece: int):
        self.piece, self.all = piece, []
        for content in (good, bad):
            held = zstandard.ZstdCompressionDict(content)
            held.precompute_compress(level=LEVEL)
            self.all.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held))
        self.all.append(zstandard.ZstdCompressor(level=LEVEL))

    def features(self, text: str | None) -> tuple[float, float]:
        parts = pieces(text, self.piece)
        size = sum(map(len, parts))
        if not size:
            return 0.0, 0.0
        good, bad, plain = (sum(len(c.compress(p)) for p in parts) for c in self.all)
        return (bad - good) / size, float(np.log((plain + 1) / (size + 1)))


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where the samples are too few or alike for training, their own bytes."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the constant."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        curve = (a.T * (weight * p * (1 - p))) @ a + ridge * np.eye(a.shape[1])
        step = np.linalg.solve(curve, a.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def bucket(doc_id: str = "doc_id", of: int = 3) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 4_000, train_pieces: int = 8_000, piece: int = 1024,
          size: int = 200_000) -> dict:
    """docs(doc_id, text), labels(doc_id, quality) of the rows to learn from -> dictionaries and calibration."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("_label"))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    place = F.xxhash64("doc_id")
    picked = [known.filter(F.col("_label") == v).orderBy(place, "doc_id").limit(train_rows) for v in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).withColumn("_builds", F.pmod(place, F.lit(2)) == 0)
    texts = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(chosen), "doc_id")  # 2 * train_rows rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(label, p) for label, text in zip(batch.column(0).to_pylist(), batch.column(1)) for p in pieces(text.as_py(), piece)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["label", "piece"])

    cuts = texts.filter("_builds").select("_label", "_text").mapInArrow(cut, "label int, piece binary")
    samples = [
        [bytes(r["piece"]) for r in cuts.filter(F.col("label") == v).orderBy(F.xxhash64("piece"), "piece").limit(train_pieces).collect()]
        for v in (0, 1)
    ]
    if not samples[0] or not samples[1]:
        return {"share": share}
    model = {"share": share, "piece": piece, "good": dictionary(samples[1], size), "bad": dictionary(samples[0], size)}
    rest = measured(texts.filter("NOT _builds").select("doc_id", F.col("_label").alias("label"), F.col("_text").alias("text")), model)
    rows = rest.toPandas().sort_values(["doc_id", "d", "r"])
    y = rows["label"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        return {"share": share}
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return model | {"weights": logistic(rows[["d", "r"]].to_numpy(), y, weight).tolist()}


def measured(rows: DataFrame, model: dict) -> DataFrame:
    """rows(…, text) -> the other columns with d (difference per byte) and r (log plain ratio)."""
    @F.pandas_udf("d double, r double")
    def features(text: pd.Series) -> pd.DataFrame:
        held = Compressors(model["good"], model["bad"], model["piece"])
        return pd.DataFrame([held.features(t) for t in text], columns=["d", "r"])

    return rows.withColumn("_f", features("text")).drop("text").select("*", "_f.d", "_f.r").drop("_f")


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs(doc_id, held_out, text) -> doc_id, held_out, d, r, score, predicted, one row per input row."""
    if "weights" not in model:
        out = docs.drop("text").withColumns({"d": F.lit(0.0), "r": F.lit(0.0), "score": F.lit(float(model["share"]))})
    else:
        a, b, c = (float(w) for w in model["weights"])
        margin = F.lit(a) * F.col("d") + F.lit(b) * F.col("r") + F.lit(c)
        out = measured(docs, model).withColumn("score", 1 / (1 + F.exp(-margin)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels are learned only where crc32(doc_id as text) mod 3 is not 1."""
    docs = docs.select("doc_id", (bucket() == 1).alias("held_out"), "text")
    model = train(docs.filter(~F.col("held_out")).drop("held_out"), labels.filter(bucket() != 1))
    return score(docs, model)
