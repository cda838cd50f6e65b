"""Hashes of all k-character stretches of many texts at once, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts in one array, and where each text begins and ends."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(points: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each stretch of ``width`` characters, by start position.

    Positions too near the end have none, so the result is shorter than the input.
    """
    n = len(points)
    if n < width:
        return np.zeros(0, np.uint64)
    base = _ODD[which]
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(points.astype(np.uint64) + np.uint64(which + 1)) * _powers(base, n), out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * _powers(inverse, n - width + 1))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of ``width`` values, by start position."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def batches(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a list with about ``most`` characters each; a longer text comes alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
