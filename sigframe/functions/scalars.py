"""Column expressions for single values (all JVM-side)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

INF = float("inf")


def divide(a: Column, b: Column) -> Column:
    """a/b with IEEE infinities for b = 0 and NULL for 0/0, independent of ANSI mode."""
    return (
        F.when(b != 0, F.try_divide(a, b))
        .when(a > 0, F.lit(INF))
        .when(a < 0, F.lit(-INF))
    )


def null_nan(x: Column) -> Column:
    """NaN is the array world's missing value; NULL is ours."""
    return F.when(~F.isnan(x), x)


def log_odds(x: Column) -> Column:
    return (
        F.when(x == 0, F.lit(-INF))
        .when(x == 1, F.lit(INF))
        .otherwise(F.ln(F.try_divide(x, 1 - x)))
    )


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clean_value(x: Column, inf: str = "zero") -> Column:
    """Missing -> 0; infinities -> 0 (``zero``) or the largest finite double (``max``)."""
    if inf not in ("zero", "max"):
        raise ValueError(f"inf must be 'zero' or 'max', got {inf!r}")
    top = 0.0 if inf == "zero" else 1.7976931348623157e308
    x = x.cast("double")
    return (
        F.when(x.isNull() | F.isnan(x), 0.0)
        .when(x == INF, top)
        .when(x == -INF, -top)
        .otherwise(x)
    )


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def ppoint(x: Column, decimals: int = 2) -> Column:
    """Fixed-point text, as in ``%.2f``."""
    return F.format_string(f"%.{decimals}f", x)


def lanczos_weight(delta: Column, cutoff: Column | float, window: float) -> Column:
    """Windowed sinc: 1 at zero, 0 beyond ``window`` lobes."""
    u = delta * cutoff
    pu = u * math.pi
    body = window * F.sin(pu) * F.sin(pu / window) / (pu * pu)
    return F.when(u == 0, 1.0).when(F.abs(u) > window, 0.0).otherwise(body)


# Coefficients of the Chebyshev fit of the complementary error function
# (relative error below 1.2e-7 everywhere), lowest order first.
ERFC_FIT = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]


def normal_upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC_FIT[-1])
    for c in reversed(ERFC_FIT[:-1]):
        poly = poly * t + c
    tail = 0.5 * t * F.exp(poly - x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def magnitude_bucket(x: Column, per_octave: int = 512) -> Column:
    """An order-preserving integer bucket of a double, ``per_octave`` buckets per power of two.

    It depends on the value alone, so two passes over the same data always agree.
    """
    base = 1100 * per_octave
    size = F.floor(F.log2(F.abs(x)) * per_octave).cast("long") + base
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, size).otherwise(-size)
