"""Lorenzo prediction of any order and rank by windows.

On the lattice of multiples of 2 eb the closed prediction loop opens: codes are integer differences along each
dimension in turn, and decoding is running sums. Values that the lattice cannot hold (not finite, too large)
keep their raw value beside code 0, and their neighbours see 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import d, lattice

LIMIT = 2.0**52


def along(df: DataFrame, dim: str, group: list[str], dims: list[str]):
    return Window.partitionBy(*group, *[c for c in dims if c != dim]).orderBy(dim)


def quantized(df: DataFrame, eb: float) -> DataFrame:
    """q on the lattice, and raw where q does not give x back within eb."""
    fits = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < d(LIMIT * eb))
    q = F.when(fits, lattice(F.col("x"), eb)).otherwise(F.lit(0).cast("long"))
    out = df.withColumn("q", q)
    ok = fits & (F.abs(F.col("q") * d(2 * eb) - F.col("x")) <= d(eb))
    return out.withColumn("raw", F.when(~ok, F.col("x")))


def encode(df: DataFrame, group: list[str], dims: list[str], order: int = 1) -> DataFrame:
    """code: q less its prediction; order 1 or 2 along every dimension."""
    out = df.withColumn("code", F.col("q"))
    for dim in dims:
        w = along(df, dim, group, dims)
        before = lambda k: F.coalesce(F.lag("code", k).over(w), F.lit(0))  # noqa: E731, B023
        out = out.withColumn("code", F.col("code") - before(1) if order == 1 else F.col("code") - 2 * before(1) + before(2))
    return out


def decode(df: DataFrame, group: list[str], dims: list[str], order: int = 1) -> DataFrame:
    """back: q from codes, by running sums along the dimensions."""
    out = df.withColumn("back", F.col("code"))
    for dim in dims:
        w = along(df, dim, group, dims).rowsBetween(Window.unboundedPreceding, 0)
        for _ in range(order):
            out = out.withColumn("back", F.sum("back").over(w))
    return out


def restored(eb: float) -> Column:
    return F.coalesce("raw", F.col("back") * d(2 * eb))


#: What quantization noise adds to a sampled prediction error, in units of eb, by order and rank.
NOISE = {(1, 1): 0.5, (1, 2): 0.81, (1, 3): 1.22, (1, 4): 1.79, (2, 1): 1.08, (2, 2): 2.76, (2, 3): 6.8}
