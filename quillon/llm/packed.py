"""Columns of numbers as one compressed binary value, for rows that carry many numbers through a shuffle."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_HEAD = struct.Struct("<cBQQ")
LEVEL = 1


def packed(*arrays: np.ndarray) -> bytes:
    """The arrays, each cut into planes of its numbers' first, second, ... bytes, which compress well."""
    out, compressor = [], zstandard.ZstdCompressor(level=LEVEL)
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
        body = compressor.compress(planes)
        out += [_HEAD.pack(a.dtype.kind.encode(), a.dtype.itemsize, len(a), len(body)), body]
    return b"".join(out)


def unpacked(raw: bytes) -> list[np.ndarray]:
    """The arrays of ``packed``."""
    out, at, raw = [], 0, memoryview(raw)
    while at < len(raw):
        kind, width, n, length = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        planes = zstandard.ZstdDecompressor().decompress(raw[at : at + length], max_output_size=max(n * width, 1))
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(f"<{kind.decode()}{width}").reshape(n))
        at += length
    return out
