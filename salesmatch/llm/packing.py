"""Compact binary columns of integers, and ragged gathers on them (numpy)."""

from __future__ import annotations

import numpy as np
import zstandard


_COMPRESS = zstandard.ZstdCompressor(level=1)
_RESTORE = zstandard.ZstdDecompressor()


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers below 2**32 as compressed byte planes."""
    planes = np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    return _COMPRESS.compress(np.ascontiguousarray(planes).tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_RESTORE.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_rising(values: np.ndarray) -> bytes:
    """Like ``pack_ints`` for a non-decreasing sequence, as differences."""
    return pack_ints(np.diff(values.astype(np.int64), prepend=0))


def unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(data).astype(np.int64))


def pack_bytes(data: bytes) -> bytes:
    return _COMPRESS.compress(data)


def unpack_bytes(data: bytes) -> bytes:
    return _RESTORE.decompress(data)


def offsets(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def ragged_take(off: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``values[off[r]:off[r + 1]]`` for every r of ``rows``; also returns the new offsets."""
    start = off[rows]
    out = offsets(off[rows + 1] - start)
    at = np.arange(out[-1]) + np.repeat(start - out[:-1], np.diff(out))
    return values[at], out
