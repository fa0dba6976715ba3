"""Flat numpy arrays: segment sums and hashes of many spans at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``starts`` (the last of which is the end); empty segments give 0."""
    total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[starts[1:]] - total[starts[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``count``."""
    out = np.full(max(count, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the byte spans ``data[starts:ends]``, which must be adjacent and cover ``data``."""
    lengths = ends - starts
    rank = np.arange(len(data)) - np.repeat(starts, lengths)
    terms = _BYTES[data] * powers(_BASE, int(lengths.max()) if len(lengths) else 1)[rank]
    return mix64(segment_sums(terms, np.append(starts, len(data))) + lengths.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
