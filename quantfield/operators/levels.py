"""Levels of a field by k-means in one dimension, exactly, on a histogram of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 512


def bounded_histogram(df: DataFrame, x: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean value and count of each of at most CELLS equal cells of the range of x; nulls and non-finite values are left out."""
    v = df.select(F.col(x).cast("double").alias("x")).where("x is not null and not isnan(x) and abs(x) < double('infinity')")
    lo, hi = v.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        return np.zeros(0), np.zeros(0)
    cell = F.least(F.lit(CELLS - 1), F.floor((F.col("x") - lo) / ((hi - lo) / CELLS))) if hi > lo else F.lit(0)
    rows = v.groupBy(cell.alias("cell")).agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()  # CELLS rows at most
    return np.array([r.m for r in rows]), np.array([r.n for r in rows], np.float64)


def optimal_levels(x: np.ndarray, n: np.ndarray, most: int) -> list[tuple[np.ndarray, float]]:
    """For k = 1 to `most`: the centres of k clusters of sorted values x with weights n that have the least sum of squares, and that sum."""
    w, s, ss = (np.append(0, np.cumsum(n * x**p)) for p in (0, 1, 2))

    def cost(a, z):  # of values a to z - 1 as one cluster
        return ss[z] - ss[a] - (s[z] - s[a]) ** 2 / (w[z] - w[a])

    best, cut, out = np.append(0, cost(np.zeros(len(x), int), np.arange(1, len(x) + 1))), [], []
    for k in range(1, min(most, len(x)) + 1):
        if k > 1:
            now, where = np.full(len(x) + 1, np.inf), np.zeros(len(x) + 1, int)
            for z in range(k, len(x) + 1):
                a = np.arange(k - 1, z)
                c = best[a] + cost(a, np.full(len(a), z))
                where[z] = a[c.argmin()]
                now[z] = c.min()
            best = now
            cut.append(where)
        ends = [len(x)]
        for where in reversed(cut):
            ends.append(int(where[ends[-1]]))
        ends = [0, *ends[::-1]] if ends[-1] else ends[::-1]
        out.append((np.array([(s[z] - s[a]) / (w[z] - w[a]) for a, z in zip(ends, ends[1:])]), max(0.0, float(best[len(x)]))))
    return out
