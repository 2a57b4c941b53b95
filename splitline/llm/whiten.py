"""Embedding whitening by a two-pass covariance.

1. First pass: number, length and exact integer sums of the fitted vectors, per
   task in NumPy and merged as Python integers; the mean is S / n.
2. Second pass: every task centres its vectors in blocks and adds their outer
   products (one NumPy matrix product a block); treeAggregate merges the tasks'
   d x d sums in several levels, so the driver gets a few matrices whatever the
   number of tasks.
3. The driver solves the symmetric d x d system with LAPACK. The projection (d x
   k) goes to the tasks, which whiten every row where it lies. Nothing that is
   shipped grows with the number of rows.
4. A third pass measures the covariance of the whitened rows: its largest
   difference from the identity is reported on every row.

Entries are fixed point: x = floor(1024 * c) + 100000, c as double. Sums and the
squared deviation are exact integers; a sum or deviation beyond 64 bits, or an
entry beyond 2**53, is an error and not a wrapped number.

Defined cases: vectors that are null, empty or hold a null or non-finite entry
take no part, nor do vectors of another length than most have (of two lengths
equally common, the longer counts); rows with a null or repeated id take part
and each report; components are given up to ``k``, fewer where there are fewer
dimensions or where an eigenvalue is no more than rounding (1e-12 of the
largest), as along them all rows are equal; so a table of equal vectors, and an
empty one, give no rows. Eigenvectors have one sign: their largest entry (the
first of equals) is positive. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

SCALE, SHIFT = 1024, 100_000
EXACT = 1 << 53


def _fixed(column: pa.Array):
    """(places, x) for each length of the vectors of ``column`` that take part: where they stand, and their entries as int64 in fixed point."""
    values = column.flatten().to_numpy(zero_copy_only=False)  # null entries become NaN
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    stop = np.cumsum(length)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (length > 0) & (bad[stop] == bad[stop - length])
    for d in np.unique(length[good]).tolist():
        at = np.flatnonzero(good & (length == d))
        x = np.floor(values[(stop[at] - d)[:, None] + np.arange(d)] * SCALE)
        if np.abs(x).max() > EXACT - SHIFT:
            raise OverflowError("an entry does not fit 53 bits")
        yield at, x.astype(np.int64) + SHIFT


def _blocks(batches, d: int):
    """(ids, x) of the vectors of length ``d`` in each Arrow batch of (vec_id, embedding)."""
    for b in batches:
        for at, x in _fixed(b.column(1)):
            if x.shape[1] == d:
                yield b.column(0).take(pa.array(at)), x


def _totals(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length: the number of vectors and their exact sums."""

    def run(batches):
        n, sums = {}, {}
        for b in batches:
            for at, x in _fixed(b.column(1)):
                d = x.shape[1]
                n[d] = n.get(d, 0) + len(at)
                part = x.sum(axis=0) if len(at) * int(np.abs(x).max()) < 1 << 62 else x.astype(object).sum(axis=0)
                sums[d] = [int(p) + q for p, q in zip(part, sums.get(d, [0] * d))]
        for d in n:
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n[d]], pa.int64()), pa.array([list(map(str, sums[d]))], pa.list_(pa.string()))], names=["d", "n", "s"])

    def add(total, r):
        return both(total, {r.d: (r.n, list(map(int, r.s)))})

    def both(a, b):
        out = dict(a)
        for d, (n, s) in b.items():
            m, t = out.get(d, (0, [0] * d))
            out[d] = (m + n, [p + q for p, q in zip(s, t)])
        return out

    return rows.mapInArrow(run, "d int, n long, s array<string>").rdd.treeAggregate({}, add, both, depth=3)


def _merged(parts: DataFrame, d: int) -> np.ndarray:
    """The sum of the tasks' d x d matrices (column m, as bytes), merged in levels on the executors."""
    zero = np.zeros((d, d))
    add = lambda a, r: a + np.frombuffer(bytes(r.m)).reshape(d, d)
    return parts.rdd.treeAggregate(zero, add, lambda a, b: a + b, depth=3)


def _outer(rows: DataFrame, d: int, centred) -> np.ndarray:
    """Sum over all rows of the outer product of what ``centred`` makes of a block."""

    def run(batches):
        total = None
        for _, x in _blocks(batches, d):
            z = centred(x)
            m = z.T @ z
            total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    return rows.mapInArrow(run, "m binary")


@dataclass
class Whitening:
    """A fitted projection: whitened = (x - mean) @ projection."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        """S / n in double precision; integer division keeps the digits that a double quotient of large numbers would lose."""
        return np.array([s // self.n + (s % self.n) / self.n for s in self.sums])


def fit(rows: DataFrame, k: int = 8) -> Whitening | None:
    """The whitening of ``rows`` (vec_id, embedding array<double>); None where none takes part."""
    totals = _totals(rows)
    if not totals:
        return None
    d = max(totals, key=lambda d: (totals[d][0], d))
    model = Whitening(*totals[d], np.zeros((d, 0)), np.zeros(0))
    mean = model.mean
    v = _merged(_outer(rows, d, lambda b: b - mean), d) / model.n
    values, directions = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:k]
    order = order[values[order] > 1e-12 * max(values[-1], 0.0)] if values[-1] > 0 else order[:0]
    e, w = values[order], directions[:, order]
    lead = w[np.abs(w).argmax(axis=0), np.arange(len(order))]
    model.projection, model.explained = w * np.where(lead < 0, -1.0, 1.0) / np.sqrt(e), e / np.trace(v)
    return model


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance (divisor n) less the identity, measured over all rows."""
    d, k = model.projection.shape
    mean, p, one = model.mean, model.projection, np.ones
    with_one = lambda b: np.hstack([(b - mean) @ p, one((len(b), 1))])  # noqa: E731  the last row and column give the sums

    def run(batches):
        total = np.zeros((k + 1, k + 1))
        for _, b in _blocks(batches, d):
            z = with_one(b)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    got = _merged(rows.mapInArrow(run, "m binary"), k + 1) / model.n
    return float(np.abs(got[:k, :k] - np.outer(got[k, :k], got[k, :k]) - np.eye(k)).max())  # the rows are centred already, so their mean is rounding alone


def transform(rows: DataFrame, model: Whitening, error: float) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row that takes part and component."""
    d, k = model.projection.shape
    n, mean, p, explained = model.n, model.mean, model.projection, model.explained
    sums = np.array(model.sums, dtype=object)

    def deviations(b: np.ndarray) -> list[int]:
        """Sums of (n * x - S) ** 2. 64-bit arithmetic where it provably fits, else Python's integers."""
        widest = n * int(np.abs(b).max()) + max(abs(s) for s in model.sums)
        if widest < 1 << 62:
            z = b * n - sums.astype(np.int64)
            if int(np.abs(z).max()) ** 2 * d < 1 << 63:
                return (z * z).sum(axis=1).tolist()
        out = [int(((row * n - sums) ** 2).sum()) for row in b.astype(object)]
        if max(out) >= 1 << 63:
            raise OverflowError("a deviation does not fit 64 bits")
        return out

    def run(batches):
        for ids, b in _blocks(batches, d):
            w = (b - mean) @ p
            at = np.repeat(np.arange(len(b)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(b))), pa.array(np.full(len(at), n, dtype=np.int64)),
                    pa.array(np.array(deviations(b), dtype=np.int64)[at]), pa.array(w.ravel()), pa.array(np.tile(explained, len(b))), pa.array(np.full(len(at), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, RESULT)


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, k: int = 8, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Fits the whitening on ``rows`` and applies it to them."""
    own = rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))
    model = fit(own, k)
    if model is None or not model.projection.shape[1]:
        return rows.sparkSession.createDataFrame([], RESULT)
    return transform(own, model, identity_error(own, model))
