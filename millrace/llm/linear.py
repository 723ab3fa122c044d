"""Small fits shared by the classifiers: summed counter tables and hashed linear models."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exchange, per_task, record

SLICES = 8


def counter_rows(counts: np.ndarray) -> pa.RecordBatch:
    """A task's int64 counters as SLICES rows (k, bytes)."""
    parts = counts.reshape(SLICES, -1)
    return record(k=pa.array(np.arange(SLICES), pa.int32()), bytes=pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary()))


def summed_counters(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' counters; their number is fixed by the caller, whatever the input."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(raw), np.int64)
        for k, x in sums.items():
            yield record(k=pa.array([k], pa.int32()), bytes=pa.array([x.tobytes()], pa.binary()))

    out = np.zeros((SLICES, size // SLICES), np.int64)
    for k, raw in per_task(exchange(rows, "k", SLICES), "k int, bytes binary", add).collect():
        out[k] = np.frombuffer(raw, np.int64)
    return out.reshape(-1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


#: Entries that a step of a fit works on at a time.
FIT_ENTRIES = 1 << 18


def fit_logistic(size: np.ndarray, col: np.ndarray, value: np.ndarray, target: np.ndarray, dims: int, steps: int = 80, ridge: float = 1e-4, rate: float = 0.1) -> np.ndarray:
    """Weights, the bias last, of a logistic model on soft targets; row k has the next size[k] entries (col, value)."""
    used = np.unique(col)
    place = np.zeros(dims, np.int32)
    place[used] = np.arange(len(used))
    col = place[col]
    ends = np.cumsum(size)
    # Whole rows of about FIT_ENTRIES entries: what a step holds beside the entries stays small.
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(ends[-1]), FIT_ENTRIES)), len(size))) if len(size) else np.zeros(1, np.int64)
    parts = [(x, y, int(ends[x] - size[x]), int(ends[y - 1])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    w, opt = np.zeros(len(used) + 1), Adam(len(used) + 1, rate)
    for _ in range(steps):
        g = np.zeros(len(w))
        for x, y, low, high in parts:
            row, c, v = np.repeat(np.arange(y - x), size[x:y]), col[low:high], value[low:high]
            z = np.bincount(row, w[c] * v, y - x) + w[-1]
            d = (sigmoid(z) - target[x:y]) / len(target)
            g[:-1] += np.bincount(c, d[row] * v, len(used))
            g[-1] += d.sum()
        g[:-1] += ridge * w[:-1]
        w -= opt.step(g)
    out = np.zeros(dims + 1)
    out[used], out[-1] = w[:-1], w[-1]
    return out


def first_by_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those of smallest key hash: the bounded sample that a fit may use."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), key).limit(most)
