"""Entropy coding of chunks. Code tables come from Spark aggregates; tasks only pack and unpack bits.

A chunk is one row: key, chunk, codes (array of long). Chunks are bounded (CHUNK cells), so a task holds one at
a time. Canonical Huffman codes are built from one histogram for the whole field, whose rows are the distinct
symbols (twice the quantizer's radius at most)."""

from __future__ import annotations

import heapq
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 14
MAGIC, VERSION = b"QFLD", 1


def chunks(cells: DataFrame, value: str) -> DataFrame:
    """key, chunk, codes: CHUNK cells each, in order of i0."""
    c = cells.withColumn("chunk", F.floor(F.col("i0") / CHUNK).cast("long"))
    packed = c.groupBy("key", "chunk").agg(F.sort_array(F.collect_list(F.struct("i0", F.col(value).cast("long").alias("v")))).alias("s"))
    return packed.select("key", "chunk", F.col("s.v").alias("codes"))


def histogram(cells: DataFrame, value: str) -> DataFrame:
    return cells.groupBy(F.col(value).cast("long").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths; one symbol alone gets one bit."""
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    length, tick = dict.fromkeys(counts, 0), len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], tick, a[2] + b[2]))
        tick += 1
    return length


def canonical(lengths: dict[int, int]) -> dict[int, str]:
    """Symbol -> bits: codes of one length are consecutive, in order of symbols."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        out[s], last = format(code, f"0{n}b"), n
        code += 1
    return out


def huffman_pack(codes: np.ndarray, bits: dict[int, str]) -> bytes:
    text = "".join(map(bits.__getitem__, codes.tolist()))
    return np.packbits(np.frombuffer(text.encode(), np.uint8) - 48).tobytes()


def huffman_unpack(raw: bytes, n: int, bits: dict[int, str]) -> list[int]:
    symbol = {(len(b), int(b, 2)): s for s, b in bits.items()}
    out, size, code = [], 0, 0
    for bit in np.unpackbits(np.frombuffer(raw, np.uint8)).tolist():
        size, code = size + 1, code << 1 | bit
        if (size, code) in symbol:
            out.append(symbol[size, code])
            size = code = 0
            if len(out) == n:
                break
    return out


def container(codes: np.ndarray, bits: dict[int, str], config: str) -> bytes:
    """Header (magic, version, kind, cells, payload size), payload, settings. Kind 0: Huffman bits under a
    byte compressor; kind 1: plain values under it, where they are smaller."""
    plain = zlib.compress(codes.astype("<i8").tobytes(), 3)
    coded = zlib.compress(huffman_pack(codes, bits), 3) if len(codes) else plain
    kind, body = (0, coded) if len(coded) < len(plain) else (1, plain)
    return struct.pack("<4sHHQQ", MAGIC, VERSION, kind, len(codes), len(body)) + body + config.encode()


def opened(raw: bytes, bits: dict[int, str]) -> tuple[np.ndarray, dict]:
    magic, version, kind, n, size = struct.unpack_from("<4sHHQQ", raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a container of this version")
    body = zlib.decompress(raw[24 : 24 + size])
    codes = np.frombuffer(body, "<i8") if kind else np.array(huffman_unpack(body, n, bits), np.int64)
    return codes, json.loads(raw[24 + size :] or b"{}")


def encode_containers(packed: DataFrame, counts: DataFrame, config: str) -> tuple[DataFrame, dict[int, str]]:
    """key, chunk, cells, data; and the code table."""
    bits = canonical(code_lengths({r.symbol: r.n for r in counts.collect()}))
    shared = packed.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for b in batches:
            codes = [np.array(c, np.int64) for c in b.column(2).to_pylist()]
            data = [container(c, shared.value, config) for c in codes]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(c) for c in codes], pa.int64()), pa.array(data, pa.binary())], names=["key", "chunk", "cells", "data"])

    key = dict(packed.dtypes)["key"]
    return packed.mapInArrow(run, f"key {key}, chunk long, cells long, data binary"), bits


def decode_containers(stored: DataFrame, bits: dict[int, str]) -> DataFrame:
    """key, i0, code."""
    shared = stored.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for b in batches:
            out = [opened(x, shared.value)[0] for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tolist() for x in out], pa.list_(pa.int64()))], names=["key", "chunk", "codes"])

    key = dict(stored.dtypes)["key"]
    got = stored.select("key", "chunk", "data").mapInArrow(run, f"key {key}, chunk long, codes array<long>")
    return got.select("key", "chunk", F.posexplode("codes").alias("p", "code")).select("key", (F.col("chunk") * CHUNK + F.col("p")).alias("i0"), "code")


def passes(n: int):
    """For each level, from coarse to fine: the places it predicts, and their neighbours' distance (0: the first place)."""
    if n:
        yield np.array([0]), 0
    stride = 1 << max(0, int(np.ceil(np.log2(max(1, n)))))
    while stride > 1:
        half = stride // 2
        at = np.arange(half, n, stride)
        if len(at):
            yield at, half
        stride = half


def predicted(back: np.ndarray, at: np.ndarray, half: int) -> np.ndarray:
    """Cubic inside, linear or copied at the edges, from the values known at a level."""
    if not half:
        return np.zeros(len(at))
    n = len(back)
    pick = lambda k: back[np.clip(at + k, 0, n - 1)]
    has = lambda k: (at + k >= 0) & (at + k < n)
    b, c, a, e = pick(-half), pick(half), pick(-3 * half), pick(3 * half)
    with np.errstate(invalid="ignore", over="ignore"):
        pred = np.where(has(half), (b + c) / 2, b)
        pred = np.where(has(half) & has(-3 * half) & has(3 * half), (-a + 9 * b + 9 * c - e) / 16, pred)
    return np.nan_to_num(pred, nan=0, posinf=0, neginf=0)


def interpolate(x: np.ndarray, eb: float, radius: int = 32768) -> tuple[np.ndarray, np.ndarray]:
    """codes (0 where the raw value stays) and reconstruction of one chunk, level by level, each from what the ones before gave back."""
    x = np.asarray(x, np.float64)
    codes, back = np.zeros(len(x), np.int64), np.zeros(len(x))
    for at, half in passes(len(x)):
        pred = predicted(back, at, half)
        diff = x[at] - pred
        with np.errstate(invalid="ignore", over="ignore"):
            k = np.floor(np.abs(diff) / (2 * eb) + 0.5) * np.sign(diff)
            value = pred + 2 * eb * k
            ok = (np.abs(value - x[at]) <= eb) & (np.abs(k) < radius)
        codes[at] = np.where(ok, np.nan_to_num(k, nan=0, posinf=0, neginf=0) + radius, 0).astype(np.int64)
        back[at] = np.where(ok, value, x[at])
    return codes, back


def uninterpolate(codes: np.ndarray, raw: np.ndarray, eb: float, radius: int = 32768) -> np.ndarray:
    """What interpolate gave back, from its codes, and raw values where these are 0."""
    back = np.zeros(len(codes))
    for at, half in passes(len(codes)):
        back[at] = np.where(codes[at] == 0, raw[at], predicted(back, at, half) + 2 * eb * (codes[at] - radius))
    return back
