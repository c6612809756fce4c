"""Daubechies' wavelet of four taps over rows of one length, a power of two, with the row read as a ring.

Defined results of on_vectors: vectors that are null, hold nulls, or are of another length give null coefficients."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: ((1, 3, 3, 1) +- sqrt(3) (1, 1, -1, -1)) / (4 sqrt(2)).
_R3, _BY = 3**0.5, 4 * 2**0.5
TAPS = ((1 + _R3) / _BY, (3 + _R3) / _BY, (3 - _R3) / _BY, (1 - _R3) / _BY)
DETAIL = (TAPS[3], -TAPS[2], TAPS[1], -TAPS[0])


def _both(n: int) -> np.ndarray:
    """One level as an orthogonal matrix: n / 2 smooth rows, then n / 2 of details."""
    out, k = np.zeros((n, n)), np.arange(n // 2)
    for j in range(4):
        np.add.at(out, (k, (2 * k + j) % n), TAPS[j])
        np.add.at(out, (n // 2 + k, (2 * k + j) % n), DETAIL[j])
    return out


def forward(x: np.ndarray) -> np.ndarray:
    """Coefficients of each row: two smooth ones, then details from coarse to fine."""
    out, n = np.array(x, np.float64), x.shape[1]
    while n > 2:
        out[:, :n] = out[:, :n] @ _both(n).T
        n //= 2
    return out


def inverse(w: np.ndarray) -> np.ndarray:
    out, n = np.array(w, np.float64), 4
    while n <= w.shape[1]:
        out[:, :n] = out[:, :n] @ _both(n)
        n *= 2
    return out


def on_vectors(df: DataFrame, key: str, column: str, size: int, back: bool = False) -> DataFrame:
    """key, w: the coefficients of an array column; back: the values that coefficients give."""
    if size < 2 or size & (size - 1):
        raise ValueError("the size must be a power of two")

    def run(batches):
        for b in batches:
            rows = b.column(1).to_pylist()
            good = [k for k, v in enumerate(rows) if v is not None and len(v) == size and None not in v]
            x = np.array([rows[k] for k in good], np.float64).reshape(-1, size)
            found = dict(zip(good, (inverse(x) if back else forward(x)).tolist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([found.get(k) for k in range(len(rows))], pa.list_(pa.float64()))], names=[key, "w"])

    return df.select(key, column).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, w array<double>")
