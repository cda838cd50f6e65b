"""A small maximum-entropy classifier over hashed string features.

Trained on the driver from a bounded sample of labelled rows, applied inside
tasks. Its weights are one array, sent to the workers with the function.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

SPACE = 1 << 18


def hashed(features: Iterable[str]) -> list[int]:
    return [crc32(f.encode("utf-8", "surrogatepass")) % SPACE for f in features]


class MaxEnt:
    """Binary logistic model; ``score`` is the log-odds of the positive class."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def score(self, features: Iterable[str]) -> float:
        w = self.weights
        return sum(float(w[i]) for i in hashed(features))

    def table(self) -> list[float]:
        """The weights as plain floats, which are quicker to read one by one."""
        return self.weights.tolist()


def fit(
    rows: Sequence[Sequence[str]], labels: Sequence[bool], epochs: int = 6, rate: float = 0.3, penalty: float = 1e-6
) -> MaxEnt:
    """AdaGrad on the logistic loss; the order of rows is fixed, so is the result."""
    weights, seen = np.zeros(SPACE), np.full(SPACE, 1e-2)
    if not rows:
        return MaxEnt(weights.astype(np.float32))
    known: dict[str, int] = {}
    parts = [np.array([known[f] if f in known else known.setdefault(f, hashed((f,))[0]) for f in r], np.int64) for r in rows]
    target = np.asarray(labels, float)
    order = np.random.default_rng(0).permutation(len(rows))
    batch = max(16, min(256, len(rows) // 40))
    for _ in range(epochs):
        for start in range(0, len(rows), batch):
            part = order[start : start + batch]
            sizes = np.array([len(parts[i]) for i in part])
            flat = np.concatenate([parts[i] for i in part])
            row = np.repeat(np.arange(len(part)), sizes)
            z = np.clip(np.bincount(row, weights[flat], len(part)), -30, 30)
            error = 1 / (1 + np.exp(-z)) - target[part]
            used, inverse = np.unique(flat, return_inverse=True)
            step = np.bincount(inverse, error[row]) / len(part) + penalty * weights[used]
            seen[used] += step**2
            weights[used] -= rate * step / np.sqrt(seen[used])
    return MaxEnt(weights.astype(np.float32))


def bounded_sample(rows: DataFrame, id_col: str, limit: int, condition: str = "true", n: int | None = None) -> list[Row]:
    """At most ``limit`` rows on the driver for which ``condition`` holds, those whose ids have the smallest hashes.

    Rows that can't be among them, going by the number ``n`` of rows for which it
    holds, are dropped before it is evaluated and before they are ordered, so that
    all tasks together send about twice the limit.
    """
    if n is None:
        n = rows.where(condition).select(id_col).count()
    share = min(1.0, 2.0 * limit / n) if n else 1.0
    place = F.pmod(F.xxhash64(id_col), F.lit(1_000_000))
    chosen = rows.where(place < F.lit(max(1, round(share * 1_000_000)))) if share < 1 else rows
    return chosen.where(condition).orderBy(place, id_col).limit(limit).collect()


def list_rows(column: pa.ListArray) -> list[list | None]:
    """What ``column.to_pylist()`` gives for arrays of strings, quicker: all elements at once, cut at the rows' bounds."""
    bounds, values = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False).tolist()
    rows = [values[a:b] for a, b in zip(bounds, bounds[1:])]
    return [r if ok else None for r, ok in zip(rows, column.is_valid().to_pylist())] if column.null_count else rows
