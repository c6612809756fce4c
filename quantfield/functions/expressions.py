"""Column expressions: error bounds, quantizers, interpolation stencils, block indices. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def d(x: float) -> Column:
    return F.lit(float(x))


# --- error bounds; value_range, n: aggregates of the field -------------------------------------------


def bound(mode: str, value_range: Column, n: Column, abs_bound=0.0, rel_bound=0.0, psnr=0.0, l2=0.0) -> Column:
    """The absolute bound that a mode asks for."""
    rel = d(rel_bound) * value_range
    return {
        "ABS": d(abs_bound),
        "REL": rel,
        # Uniform errors in 99 % of the cells give this mean square.
        "PSNR": value_range * F.pow(d(10), -(d(psnr) + d(10) * F.log10(d(1) - d(2.0 / 3.0 * 0.99))) / d(20)),
        "L2NORM": F.sqrt(F.try_divide(d(3), n)) * d(l2),
        "ABS_AND_REL": F.least(d(abs_bound), rel),
        "ABS_OR_REL": F.greatest(d(abs_bound), rel),
    }[mode]


# --- quantizers ------------------------------------------------------------------------------------


def as_column(v) -> Column:
    return v if isinstance(v, Column) else d(v)


def code(x: Column, pred: Column, eb, radius: int = 32768, slack: float = 1.0) -> Column:
    """Residual in units of 2 eb, half away from zero, as radius + k; 0 where x must be kept raw. eb: a number, or a column
    where bounds differ by cell. slack: an error up to so many times the bound is let through."""
    diff, e = x - pred, as_column(eb)
    usable = ~F.isnan(x) & (F.abs(diff) < d(2.0 * radius) * e)
    half = F.floor(F.when(usable, F.try_divide(F.abs(diff), e))) + 1
    k = F.floor(half / 2).cast("long")
    signed = F.when(diff < 0, -k).otherwise(k)
    near = F.abs(pred + d(2) * e * signed - x) <= d(slack) * e
    return F.when(usable & (half < 2 * radius) & near, signed + radius).otherwise(F.lit(0)).cast("long")


def recovered(code_: Column, pred: Column, raw: Column, eb, radius: int = 32768) -> Column:
    return F.when(code_ != 0, pred + d(2) * as_column(eb) * (code_ - radius)).otherwise(raw)


def lattice(x: Column, eb: float) -> Column:
    """The multiple of 2 eb nearest to x: the one rounding rule of all integer stencils."""
    return F.floor(x / d(2 * eb) + d(0.5)).cast("long")


def level_of(x: Column, start: float, step: float) -> Column:
    return F.floor((x - d(start)) / d(step) + d(0.5)).cast("long")


# --- interpolation stencils; their weights are fixed values: a, b, c, e are values at -3, -1, +1, +3 steps ---------------------------------


def _sum(*terms: tuple[float, Column]) -> Column:
    out = d(terms[0][0]) * terms[0][1]
    for w, x in terms[1:]:
        out = out + d(w) * x
    return out


def linear(b, c):
    return (b + c) / d(2)


def extrapolated(a, b):
    return _sum((-0.5, a), (1.5, b))


def quad_first(b, c, e):
    return _sum((3, b), (6, c), (-1, e)) / d(8)


def quad_last(a, b, c):
    return _sum((-1, a), (6, b), (3, c)) / d(8)


def quad_beyond(z, a, b):
    return _sum((3, z), (-10, a), (15, b)) / d(8)


def cubic(a, b, c, e):
    return _sum((-1, a), (9, b), (9, c), (-1, e)) / d(16)


#: Other four-point stencils: weights of a, b, c, e, and what their sum is divided by.
FOUR_POINT = {
    "cubic_natural": ((-3, 23, 23, -3), 40),
    "cubic_front": ((5, 15, -5, 1), 16),
    "cubic_front_2": ((1, 6, -4, 1), 4),
    "cubic_back_1": ((1, -5, 15, 5), 16),
    "cubic_back_2": ((-5, 21, -35, 35), 16),
}


def four_point(name, a, b, c, e):
    weights, by = FOUR_POINT[name]
    return _sum(*zip(weights, (a, b, c, e))) / d(by)


def akima(a, b, c, e):
    """The middle of the line, less an eighth of the harmonic mean of both inner points' second differences where
    these bend the same way (Akima's weights: each bend by the size of the other)."""
    u, v = a - d(2) * b + c, b - d(2) * c + e
    return (b + c) / d(2) - F.when((u * v > d(0)) & (F.abs(u) + F.abs(v) > d(1e-9)), d(2) * u * v / (u + v)).otherwise(d(0)) / d(8)


def pchip(a, b, c, e):
    """The middle of the monotone cubic: slopes at both inner points are harmonic means of the slopes beside them, 0 at a turn."""
    u, v, w = b - a, c - b, e - c
    slope = lambda p, q: F.when(p * q > 0, d(2) * p * q / (p + q)).otherwise(d(0))
    return (b + c) / d(2) + (slope(u, v) - slope(v, w)) / d(8)
