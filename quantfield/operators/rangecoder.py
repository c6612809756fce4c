"""Range coding of chunks of symbols with an asymmetric numeral system: near the entropy, without whole bits for each symbol.

A chunk carries its own counts, so no table is gathered on the driver or sent to tasks. A chunk without symbols is empty bytes."""

from __future__ import annotations

import struct

import numpy as np

#: The state stays between total * LOW and total * LOW * 256.
LOW = 1 << 16


def pack(codes: np.ndarray) -> bytes:
    """Symbols, counts, last state and bytes."""
    if not len(codes):
        return b""
    symbols, place, counts = np.unique(np.asarray(codes, np.int64), return_inverse=True, return_counts=True)
    total, below = len(codes), (np.cumsum(counts) - counts).tolist()
    times, state, out = counts.tolist(), len(codes) * LOW, bytearray()
    for s in place[::-1].tolist():
        f = times[s]
        while state >= (f * LOW) << 8:
            out.append(state & 255)
            state >>= 8
        state = state // f * total + state % f + below[s]
    return struct.pack("<IQ", len(symbols), state) + symbols.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + bytes(out[::-1])


def unpack(raw: bytes) -> np.ndarray:
    """The symbols of pack; bytes that end early are an error."""
    if not raw:
        return np.zeros(0, np.int64)
    n, state = struct.unpack_from("<IQ", raw)
    symbols = np.frombuffer(raw, "<i8", n, 12)
    counts = np.frombuffer(raw, "<u4", n, 12 + 8 * n).astype(np.int64)
    total, times, below = int(counts.sum()), counts.tolist(), (np.cumsum(counts) - counts).tolist()
    owner, at, out = np.repeat(np.arange(n), counts).tolist(), 12 + 12 * n, []
    for _ in range(total):
        rest = state % total
        s = owner[rest]
        out.append(s)
        state = times[s] * (state // total) + rest - below[s]
        while state < total * LOW:
            state = state << 8 | raw[at]
            at += 1
    return symbols[np.array(out)]
