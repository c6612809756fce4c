"""Interpolation of fields of one to four dimensions, level by level, with feedback.

Cells whose indices are all multiples of the anchor stride are kept raw. Each level halves the stride: along one dimension
after the other the cells between known ones are predicted from them and quantized within the level's bound; coarse levels
have tighter bounds, for what follows leans on them. A slab is one group: its size is bounded by the caller.

Defined results: cells that are missing, null or not finite are kept raw, and so are those predicted from them. Of rows
with one place the last in order of x counts for all. An empty table gives no rows."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import ANCHOR_STRIDE


def orders(rank: int) -> list[tuple[int, ...]]:
    """The orders in which a level takes the dimensions; a direction is a place in this list."""
    return list(permutations(range(rank)))


def level_bound(eb: float, level: int, alpha: float, beta: float) -> float:
    """The bound of a level, from 1, the finest: divided by alpha for each level above, by beta at most."""
    return eb / min(alpha ** (level - 1), beta)


def midpoints(known: np.ndarray, count: int, cubic: bool) -> np.ndarray:
    """Along the last axis: predictions for the count places after each known one."""
    n = known.shape[-1]
    at = np.arange(count)
    inside = at + 1 < n
    take = lambda k: known[..., np.clip(at + k, 0, n - 1)]
    a, b, c, e = take(-1), take(0), take(1), take(2)
    left, right = at > 0, at + 2 < n
    out = np.where(inside, (b + c) / 2, np.where(left, -0.5 * a + 1.5 * b, b))
    if cubic:
        out = np.where(left & right, (-a + 9 * b + 9 * c - e) / 16, out)
        out = np.where(~left & right, (3 * b + 6 * c - e) / 8, out)
        out = np.where(left & inside & ~right, (-a + 6 * b + 3 * c) / 8, out)
    return out


def walk(shape: tuple[int, ...], stride: int, order: tuple[int, ...]):
    """level, dimension, slices: in turn, all cells of a pass along the dimension, known ones first and every other one."""
    half = stride // 2
    while half:
        for k, dim in enumerate(order):
            step = {x: half for x in order[: k + 1]}
            yield half.bit_length(), dim, tuple(slice(None, None, step.get(x, 2 * half)) for x in range(len(shape)))
        half //= 2


def run(x: np.ndarray, codes: np.ndarray | None, eb: float, stride: int, direction: int = 0, cubic: bool = True, alpha: float = 1.25, beta: float = 2.0, radius: int = 32768) -> tuple[np.ndarray, np.ndarray]:
    """Codes and the field read back. codes None: encode; otherwise x need hold raw values only where codes are 0."""
    back = np.array(x, np.float64)
    out = np.zeros(x.shape, np.int64)
    for level, dim, cells in walk(x.shape, stride, orders(x.ndim)[direction]):
        bound = level_bound(eb, level, alpha, beta)
        view, code = np.moveaxis(back[cells], dim, -1), np.moveaxis(out[cells], dim, -1)
        place, found = view[..., 1::2], code[..., 1::2]
        if not place.size:
            continue
        p = midpoints(view[..., ::2], place.shape[-1], cubic)
        if codes is None:
            with np.errstate(invalid="ignore", over="ignore"):
                diff = place - p
                k = np.floor(np.abs(diff) / bound / 2 + 0.5) * np.sign(diff)
                ok = (np.abs(k) < radius) & (np.abs(p + 2 * bound * k - place) <= bound)
            found[...] = np.where(ok, np.where(ok, k, 0).astype(np.int64) + radius, 0)
        else:
            found[...] = np.moveaxis(codes[cells], dim, -1)[..., 1::2]
        place[...] = np.where(found != 0, p + 2 * bound * (found - radius), place)
    return out, back


def stride_of(rank: int, shape: tuple[int, ...]) -> int:
    """The anchor stride of a rank, or the power of two that spans a smaller field."""
    return min(ANCHOR_STRIDE[rank], 1 << max(0, int(max(shape) - 1).bit_length()))


def roundtrip(cells: DataFrame, group: str, dims: list[str], eb: float, direction: int = 0, cubic: bool = True) -> DataFrame:
    """cells: group, dims, x. group, dims, x, code, back: codes of each cell, and what codes and raw values give."""

    def one(part):
        at = part[dims].to_numpy(np.int64)
        at = at - at.min(0)
        field = np.full(tuple(at.max(0) + 1), np.nan)
        field[tuple(at.T)] = part["x"].to_numpy(np.float64)
        stride = stride_of(len(dims), field.shape)
        codes, _ = run(field, None, eb, stride, direction, cubic)
        _, back = run(np.where(codes == 0, field, 0.0), codes, eb, stride, direction, cubic)
        return part.assign(code=codes[tuple(at.T)], back=back[tuple(at.T)])

    kinds = dict(cells.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [group, *dims]) + ", x double, code long, back double"
    return cells.select(group, *dims, F.col("x").cast("double").alias("x")).groupBy(group).applyInPandas(one, schema)
