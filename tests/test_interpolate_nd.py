"""Interpolation over several dimensions and the range coder, against second versions and round trips."""

import itertools

import numpy as np
import pytest

from quantfield.operators import interpolate_nd, rangecoder, wavelet


def by_cell(x, eb, stride, direction, cubic, alpha=1.25, beta=2.0, radius=32768):
    """The codec cell by cell, from its definition."""
    order, back, out = interpolate_nd.orders(x.ndim)[direction], {}, np.zeros(x.shape, np.int64)
    every = list(itertools.product(*map(range, x.shape)))
    for c in every:
        if all(i % stride == 0 for i in c):
            back[c] = x[c]
    half = stride // 2
    while half:
        bound = eb / min(alpha ** np.log2(half), beta)
        for k, dim in enumerate(order):
            new = {}
            for c in every:
                if c[dim] % (2 * half) != half or any(c[o] % half for o in order[:k]) or any(c[o] % (2 * half) for o in order[k + 1 :]):
                    continue
                a, b, d, e = (back.get((*c[:dim], c[dim] + t * half, *c[dim + 1 :])) for t in (-3, -1, 1, 3))
                if d is None:
                    p = b if a is None else -0.5 * a + 1.5 * b
                elif not cubic or (a is None and e is None):
                    p = (b + d) / 2
                elif a is None:
                    p = (3 * b + 6 * d - e) / 8
                elif e is None:
                    p = (-a + 6 * b + 3 * d) / 8
                else:
                    p = (-a + 9 * b + 9 * d - e) / 16
                q = np.sign(x[c] - p) * np.floor(abs(x[c] - p) / bound / 2 + 0.5)
                y = p + 2 * bound * q
                if abs(q) < radius and abs(y - x[c]) <= bound:
                    out[c], new[c] = int(q) + radius, y
                else:
                    new[c] = x[c]
            back |= new
        half //= 2
    return out, np.array([back[c] for c in every]).reshape(x.shape)


@pytest.mark.parametrize("shape", [(1,), (2,), (37,), (9, 14), (1, 6), (5, 6, 7), (3, 4, 5, 2)])
@pytest.mark.parametrize("cubic", [True, False])
def test_against_cells(shape, cubic):
    r = np.random.default_rng(len(shape))
    x = np.cumsum(r.normal(size=shape), -1)
    for direction in (0, len(interpolate_nd.orders(len(shape))) - 1):
        for stride in (4, interpolate_nd.stride_of(len(shape), shape)):
            codes, back = interpolate_nd.run(x, None, 0.05, stride, direction, cubic)
            want, seen = by_cell(x, 0.05, stride, direction, cubic)
            assert (codes == want).all() and np.allclose(back, seen, atol=1e-12)
            assert np.abs(back - x).max() <= 0.05
            again = interpolate_nd.run(np.where(codes == 0, x, 0.0), codes, 0.05, stride, direction, cubic)[1]
            assert (again == back).all()


def test_smooth_fields_need_few_symbols():
    i, j = np.mgrid[0:128, 0:64]
    codes, _ = interpolate_nd.run(np.sin(i / 20) * np.cos(j / 15), None, 1e-3, 128)
    assert (codes == 32768).mean() > 0.9


def test_odd_cells(spark):
    rows = [(0, i, j, None if (i, j) == (2, 3) else float("nan") if (i, j) == (4, 4) else float("inf") if i == 6 else float(i * j)) for i in range(8) for j in range(8) if (i, j) != (5, 5)]
    cells = spark.createDataFrame(rows, "slab long, i0 long, i1 long, x double")
    got = {(r.i0, r.i1): r for r in interpolate_nd.roundtrip(cells, "slab", ["i0", "i1"], 0.1).collect()}
    assert len(got) == 63
    for r in got.values():
        assert r.x is None or np.isnan(r.x) or r.back == r.x or abs(r.back - r.x) <= 0.1
    assert interpolate_nd.roundtrip(cells.limit(0), "slab", ["i0", "i1"], 0.1).count() == 0


def test_range_coder():
    r = np.random.default_rng(4)
    for x in (np.zeros(0, np.int64), np.array([-7]), np.full(500, 3), r.integers(-(2**60), 2**60, 300), np.round(r.normal(size=4096) * 3).astype(np.int64)):
        raw = rangecoder.pack(x)
        assert (rangecoder.unpack(raw) == x).all()
    p = np.unique(x, return_counts=True)[1] / len(x)
    assert 8 * (len(raw) - 12 - 12 * len(p)) < -(p * np.log2(p)).sum() * len(x) * 1.01 + 64
    with pytest.raises(IndexError):
        rangecoder.unpack(raw[:-40])


def test_wavelet(spark):
    x = np.random.default_rng(5).normal(size=(6, 16))
    w = wavelet.forward(x)
    assert np.allclose(wavelet.inverse(w), x) and np.allclose((w**2).sum(1), (x**2).sum(1))
    line = np.ones((1, 16))
    assert np.allclose(wavelet.forward(line)[0, 2:], 0)
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, None), (3, [1.0, None, 2.0, 3.0]), (4, [1.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = dict(wavelet.on_vectors(df, "k", "v", 4).collect())
    assert got[1] is not None and got[2] is None and got[3] is None and got[4] is None
    with pytest.raises(ValueError):
        wavelet.on_vectors(df, "k", "v", 6)
