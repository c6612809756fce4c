"""Fields on disk and back: compress(cells, config, path) writes chunks that hold all it takes to read them; decompress(path)
gives the cells again.

A chunk is one row: key, chunk, cells, data. Its data are a header, settings as JSON, and the parts of its cells under zstd:
places, codes, and beside them the raw values of cells that no code gives back within the bound. Predictors begin anew in
each chunk, so chunks are written and read in parallel and a task holds one at a time.

Defined results: null and non-finite values come back as they are. Cells of one key and place come back in order of
their values. An empty table gives an empty folder of chunks. A bound of 0, or LOSSLESS, keeps every bit."""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import Config
from .codecs import CHUNK, MAGIC, interpolate, uninterpolate

VERSION, LEVEL = 2, 3
METHODS = ("raw", "lattice", "lorenzo1", "lorenzo2", "interpolation")
#: The predictors that an algorithm chooses from: the one whose chunk is smallest.
CHOICES = {"NOPRED": (1,), "LORENZO_REG": (2, 3), "INTERP": (4,), "INTERP_LORENZO": (2, 4), "LOSSLESS": (0,)}


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them all, and which."""
    for kind in ("<i1", "<i2", "<i4"):
        if not len(x) or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return kind.encode() + x.astype(kind).tobytes()
    return b"<i8" + x.astype("<i8").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[3:], raw[:3].decode()).astype(np.int64)


def _codes(x: np.ndarray, method: int, eb: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes, and which cells stay raw."""
    if method == 4:
        codes, _ = interpolate(x, eb, radius)
        return np.where(codes == 0, 0, codes - radius), codes == 0
    fits = np.isfinite(x) & (np.abs(x) < 2.0**52 * eb)
    q = np.floor(np.where(fits, x, 0) / (2 * eb) + 0.5).astype(np.int64)
    raw = ~(fits & (np.abs(q * (2 * eb) - np.where(fits, x, 0)) <= eb))
    for _ in range(method - 1):
        q = np.diff(q, prepend=0)
    return q, raw


def chunk_bytes(i0: np.ndarray, x: np.ndarray, null: np.ndarray, config: Config) -> bytes:
    from zstandard import ZstdCompressor

    press, eb = ZstdCompressor(level=LEVEL).compress, config.abs_bound
    best: list[bytes] | None = None
    for method in CHOICES[config.algorithm] if eb > 0 else (0,):
        q, raw = (np.zeros(0, np.int64), np.ones(len(x), bool)) if method == 0 else _codes(x, method, eb, config.radius)
        raw &= ~null
        parts = [press(_narrow(np.diff(i0, prepend=0))), press(np.packbits(null).tobytes()), press(np.packbits(raw).tobytes()), press(_narrow(q)), press(x[raw].astype("<f8").tobytes())]
        if best is None or sum(map(len, parts)) < sum(map(len, best[1:])):
            best = [struct.pack("<B", method), *parts]
    settings = json.dumps({"bound": eb, "radius": config.radius}).encode()
    sizes = [len(settings), *map(len, best[1:])]
    return struct.pack("<4sHBQ6I", MAGIC, VERSION, best[0][0], len(x), *sizes) + settings + b"".join(best[1:])


def chunk_cells(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i0, x, null."""
    from zstandard import ZstdDecompressor

    head = struct.calcsize("<4sHBQ6I")
    magic, version, method, n, *sizes = struct.unpack_from("<4sHBQ6I", data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a chunk of this version")
    ends = head + np.cumsum(sizes)
    parts = [data[e - s : e] for e, s in zip(ends.tolist(), sizes)]
    settings, (i0, null, raw, q, kept) = json.loads(parts[0]), (ZstdDecompressor().decompress(p) for p in parts[1:])
    null, raw = (np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(bool) for p in (null, raw))
    x, q, eb = np.zeros(n), _wide(q), settings["bound"]
    values = np.frombuffer(kept, "<f8")
    if method == 4:
        x[raw] = values
        x = uninterpolate(np.where(raw | null, 0, q + settings["radius"]), x, eb, settings["radius"])
    elif method:
        for _ in range(method - 1):
            q = np.cumsum(q)
        x = q * (2 * eb)
    x[raw] = values
    return np.cumsum(_wide(i0)), x, null


def compress(cells: DataFrame, config: Config, path: str) -> None:
    """cells: key, i0, x. The bound and the algorithm are the configuration's."""
    if config.algorithm not in CHOICES:
        raise ValueError(f"{config.algorithm} has no chunks")
    key = dict(cells.dtypes)["key"]
    c = cells.select("key", F.floor(F.col("i0") / CHUNK).cast("long").alias("chunk"), "i0", F.col("x").cast("double").alias("x"))
    packed = c.groupBy("key", "chunk").agg(F.sort_array(F.collect_list(F.struct("i0", "x"))).alias("s")).select("key", "chunk", F.col("s.i0").alias("i0"), F.col("s.x").alias("x"))

    def run(batches):
        for b in batches:
            n, data = [], []
            for k in range(b.num_rows):
                i0, x = b.column(2)[k].values.to_numpy(), b.column(3)[k].values
                null = x.is_null().to_numpy(zero_copy_only=False)
                n.append(len(i0))
                data.append(chunk_bytes(i0, np.where(null, 0.0, x.to_numpy(zero_copy_only=False)), null, config))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["key", "chunk", "cells", "data"])

    packed.mapInArrow(run, f"key {key}, chunk long, cells long, data binary").write.mode("overwrite").option("compression", "none").parquet(path)


def decompress(spark: SparkSession, path: str) -> DataFrame:
    """key, i0, x."""
    stored = spark.read.parquet(path).select("key", "data")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                i0, x, null = chunk_cells(b.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(i0), k))), pa.array(i0, pa.int64()), pa.array(x, pa.float64(), mask=null)], names=["key", "i0", "x"])

    return stored.mapInArrow(run, f"key {dict(stored.dtypes)['key']}, i0 long, x double")
