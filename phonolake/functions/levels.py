"""Level, gain and curve expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def amplitude_db(a: Column) -> Column:
    """20·log10, minus infinity for zero (Spark's log10(0) would be NULL)."""
    return F.when(a > 0, 20 * F.log10(a)).when(a.isNotNull(), F.lit(NEG_INF))


def power_db(p: Column) -> Column:
    return F.when(p > 0, 10 * F.log10(p)).when(p.isNotNull(), F.lit(NEG_INF))


def db_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def lufs(mean_square: Column) -> Column:
    return -0.691 + 10 * F.log10(F.greatest(F.lit(1e-12), mean_square))


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def clamp01(v: Column) -> Column:
    return clamp(v, 0.0, 1.0)


def ramp(v: Column, low: float, high: float) -> Column:
    """0 at ``low``, 1 at ``high``, straight in between."""
    return clamp01((v - low) / (high - low))


def quantize(v: Column, step: float) -> Column:
    return F.bround(v / step, 0) * step


def floor_half_db(v: Column) -> Column:
    """Round towards more attenuation in half-dB steps."""
    return F.floor((v + 1e-6) * 2) / 2


def partner_gain(incoming: Column, correlation: Column) -> Column:
    """Outgoing gain that keeps a crossfade's level for a measured correlation (0 unrelated, 1 identical)."""
    a = clamp01(F.when(is_finite(incoming), incoming).otherwise(0.0))
    rho = clamp01(F.when(is_finite(correlation), correlation).otherwise(0.0))
    inner = F.greatest(F.lit(0.0), 1 - a * a * (1 - rho * rho))
    return clamp01(-rho * a + F.sqrt(inner))


def legacy_fade(t: Column, curve: str, fade_in: bool = True) -> Column:
    """Gain at t in [0, 1] for the editing fades: linear, log, exp, s-curve, equal-power."""
    start, reach = (0.0, 1.0) if fade_in else (1.0, -1.0)
    if curve == "linear":
        g = start + reach * t
    elif curve == "log":
        g = start + reach * F.ln(1 + 9 * t) / math.log(10)
    elif curve == "exp":
        g = start + reach * (F.exp(3 * t) - 1) / (math.exp(3) - 1)
    elif curve == "s-curve":
        low, high = 1 / (1 + math.exp(6)), 1 / (1 + math.exp(-6))
        g = start + reach * ((1 / (1 + F.exp(-12 * (t - 0.5))) - low) / (high - low))
    elif curve == "equal-power":
        g = F.sin((start + reach * t) * math.pi / 2)
    else:
        raise ValueError(curve)
    return clamp01(g)


FADE_RANGE_DB = 60.0


def fade_in(t: Column, shape: Column | str) -> Column:
    """Timeline fade law at t; non-finite positions are silent."""
    shape = F.lit(shape) if isinstance(shape, str) else shape
    u = clamp01(t)
    top = 10 ** (FADE_RANGE_DB / 20)
    law = (
        F.when(shape == "EqualPower", F.sin(u * math.pi / 2))
        .when(shape == "SCurve", (1 - F.cos(u * math.pi)) / 2)
        .when(shape == "DecibelLinear", (F.pow(F.lit(10.0), u * FADE_RANGE_DB / 20) - 1) / (top - 1))
        .otherwise(u)
    )
    return F.when(is_finite(t), law).otherwise(0.0)


def fade_out(t: Column, shape: Column | str) -> Column:
    return fade_in(1 - t, shape)


def fade_position(i: Column, n: Column) -> Column:
    return i / F.greatest(F.lit(1), n - 1)
