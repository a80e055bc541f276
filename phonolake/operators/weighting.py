"""Weighting filters as block FIR with overlap: the K weighting and the 150 Hz activity high-pass.

The impulse response is made once, on the driver, and travels with the tasks. Slices of the order are filtered on their own
with a halo as long as the response, so no task holds a recording.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from phonolake.operators.ordered import with_halo


def _section(numerator, denominator, x: np.ndarray) -> np.ndarray:
    """One second-order section, direct form II transposed."""
    b, a0 = [c / denominator[0] for c in numerator], denominator[0]
    a1, a2 = denominator[1] / a0, denominator[2] / a0
    y, s, t = np.empty_like(x), 0.0, 0.0
    for i, v in enumerate(x):
        y[i] = b[0] * v + s
        s, t = b[1] * v - a1 * y[i] + t, b[2] * v - a2 * y[i]
    return y


def _high_pass(hz: float, q: float, rate: int):
    w = 2 * math.pi * hz / rate
    c, alpha = math.cos(w), math.sin(w) / (2 * q)
    return ((1 + c) / 2, -(1 + c), (1 + c) / 2), (1 + alpha, -2 * c, 1 - alpha)


def _high_shelf(hz: float, gain_db: float, rate: int):
    g, w = 10 ** (gain_db / 40), 2 * math.pi * hz / rate
    c = math.cos(w)
    root = 2 * math.sqrt(g) * (math.sin(w) / 2 * math.sqrt(2))
    top = (g * (g + 1 + (g - 1) * c + root), -2 * g * (g - 1 + (g + 1) * c), g * (g + 1 + (g - 1) * c - root))
    return top, (g + 1 - (g - 1) * c + root, 2 * (g - 1 - (g + 1) * c), g + 1 - (g - 1) * c - root)


def weighting_response(kind: str, rate: int, taps: int | None = None) -> np.ndarray:
    """Impulse response of "K" (shelf and high-pass) or "activity" (150 Hz high-pass); 0.1 s unless told otherwise, after
    which the tail is below 1e-9."""
    impulse = np.zeros(taps or max(8, rate // 10))
    impulse[0] = 1.0
    # Corner frequencies, shelf gain and Q of the weighting.
    sections = {
        "K": lambda: [_high_shelf(1681.97, 3.99982, rate), _high_pass(38.13, 0.5, rate)],
        "activity": lambda: [_high_pass(150.0, math.sqrt(0.5), rate)],
    }[kind]()
    for b, a in sections:
        impulse = _section(b, a, impulse)
    return impulse


def filtered(x: np.ndarray, response: np.ndarray) -> np.ndarray:
    """The first len(x) values of the convolution; long responses by one transform."""
    if len(response) <= 64:
        return np.convolve(x, response)[: len(x)]
    width = 1 << (len(x) + len(response) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, width) * np.fft.rfft(response, width), width)[: len(x)]


def weighted(samples: DataFrame, rate: int, kind: str = "K", seconds: float = 10.0,
             response: Sequence[float] | None = None, out: str = "v") -> DataFrame:
    """samples(rec_id, ch, n, v) with the filtered value in ``out``; ``v`` stays where ``out`` is another name. A missing or
    non-finite sample counts as 0."""
    taps = np.asarray(response if response is not None else weighting_response(kind, rate), dtype=float)
    columns = ["rec_id", "ch", "n", "v"] + ([out] if out != "v" else [])
    schema = "rec_id long, ch long, n long, " + ", ".join(f"{c} double" for c in columns[3:])
    haloed = with_halo(samples.select("rec_id", "ch", "n", "v"), "n", before=len(taps), size=int(rate * seconds))

    def convolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        y = filtered(np.nan_to_num(pdf["v"].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0), taps)
        return pdf.assign(**{out: y}).loc[pdf["_home"], columns]

    return haloed.groupBy("rec_id", "ch", "_slice").applyInPandas(convolve, schema)
