"""Whitening of embeddings: leading components by a randomised range finder.

Entries become whole numbers x = floor(1024 c) + 100000.  A pass over all rows multiplies
their covariance V with a basis Q of a few columns without ever building V: each task adds
up (x - mean)' ((x - mean) Q) over its rows, and the sums of all tasks are added cell by
cell.  The basis begins as random directions, `OVERSAMPLING` more than are wanted; every
power pass replaces it by an orthonormal basis of V Q.  Rayleigh-Ritz on the last basis
gives eigenvalues and components, and their residuals V u - e u come from the same pass.
If one of the wanted residuals is above `TOLERANCE` of the largest eigenvalue after
`POWERS` passes (a flat spectrum, say), the basis is expanded to the full dimension, where
nothing is left out; V Q is then gathered in panels of `PANEL` columns.

Rows are centred before they are multiplied, and exactly: sums are whole numbers, the mean
is split into its whole part and a rest below one.  What reaches the driver are sums of
dimension x basis cells, whatever the number of rows.

Defined cases: vectors that are null, empty, or hold null, non-finite or very large entries
(2**40 and more) are dropped, and so are vectors of another length than the commonest (of
equally common ones the longest); repeated rows and keys count as often as they stand;
components whose eigenvalue is zero within rounding cannot be scaled to one and are left
out, so that equal vectors or a single one give no rows; a deviation that exceeds a long is
null; a null key is kept; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import has_columns, materialize

SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 40)
OVERSAMPLING = 8
POWERS = 3
TOLERANCE = 1e-12
PANEL = 512
SEED = 42
#: Entries of rows that are multiplied together.
TOGETHER = 1 << 21
LONGEST = (1 << 63) - 1


@dataclass
class Fit:
    """What all rows have in common: their number, sums of each dimension, and components (columns) by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    expanded: bool = False
    identity_error: float = 0.0

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """The mean less its whole part, for each dimension."""
        return np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sum) squared, exactly."""
        off, rest = x - self.whole, [s % self.n for s in self.sums]
        if not len(x):
            return []
        largest = self.n * (int(np.abs(off).max()) + 1)
        if largest**2 * len(self.sums) <= LONGEST:
            return ((off * self.n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        found = [sum((int(o) * self.n - r) ** 2 for o, r in zip(row, rest, strict=True)) for row in off]
        return [f if f <= LONGEST else None for f in found]


def rows_of(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the vectors that can be used, written."""
    has_columns(vectors, key, vector)
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)
    entries = F.transform(vector, lambda c: c.cast("double"))
    x = F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    held = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(entries, good))
    rows = materialize(held.select(F.col(key).cast("long").alias("vec_id"), x.alias("x")))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    return rows if len(lengths) < 2 else rows.where(F.size("x") == lengths[0]["d"])


def _matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            lists = batch.column(column)
            width = max(1, len(lists[at]))
            part = batch.slice(at, max(1, TOGETHER // width))
            at += part.num_rows
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def sums(rows: DataFrame, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """make(rows of x), added up over all rows: one array of doubles, in one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches):
            total = make(x) if total is None else total + make(x)
        if total is not None:
            for i in range(0, len(total), 1 << 16):
                part = total[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.array(part)], names=["cell", "part"])

    found = rows.select("x").mapInArrow(run, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("total")).toPandas()
    out = np.zeros(len(found))
    out[found["cell"].to_numpy()] = found["total"].to_numpy()
    return out


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, []
        for _, x in _matrices(batches):
            high, low = x >> 20, x & ((1 << 20) - 1)  # parts that cannot overflow
            more = [(int(h) << 20) + int(w) for h, w in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]
            n, total = n + len(x), [a + b for a, b in zip(total, more, strict=True)] if total else more
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array(map(Decimal, [n, *total]), pa.decimal128(38, 0))], names=["cell", "part"])

    found = {r["cell"]: int(r["total"]) for r in rows.select("x").mapInArrow(run, "cell int, part decimal(38,0)").groupBy("cell").agg(F.sum("part").alias("total")).collect()}
    return found.get(-1, 0), [found[i] for i in range(len(found) - 1)]


def times(rows: DataFrame, fit: Fit, basis: np.ndarray) -> np.ndarray:
    """V times basis, by passes over all rows."""
    out = np.empty((len(basis), basis.shape[1]))
    for i in range(0, basis.shape[1], PANEL):
        part = basis[:, i : i + PANEL]

        def make(x: np.ndarray, part: np.ndarray = part) -> np.ndarray:
            off = fit.centred(x)
            return (off.T @ (off @ part)).ravel()

        out[:, i : i + PANEL] = sums(rows, make).reshape(part.shape) / fit.n
    return out


def rayleigh_ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), components and norms of their residuals, of V within the basis; product is V times basis."""
    small = basis.T @ product
    values, turned = np.linalg.eigh((small + small.T) / 2)
    values, turned = values[::-1], turned[:, ::-1]
    components = basis @ turned
    return values, components, np.linalg.norm(product @ turned - components * values, axis=0)


def fit(rows: DataFrame, wanted: int = 8, seed: int = SEED) -> Fit | None:
    """Components of rows_of(); None if there are none."""
    n, total = totals(rows)
    if not n:
        return None
    d = len(total)
    found = Fit(n, total, np.zeros(0), np.zeros((d, 0)), 0.0)
    found.trace = float(sums(rows, lambda x: np.array([(found.centred(x) ** 2).sum()]))[0]) / n
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, wanted + OVERSAMPLING))))[0]
    for _ in range(POWERS if basis.shape[1] < d else 0):
        basis = np.linalg.qr(times(rows, found, basis))[0]
    values, components, residuals = rayleigh_ritz(basis, times(rows, found, basis))
    if basis.shape[1] < d and not residuals[:wanted].max() <= TOLERANCE * values[0]:
        found.expanded = True
        values, components, _ = rayleigh_ritz(np.eye(d), times(rows, found, np.eye(d)))
    real = int((values[:wanted] > max(values[0], 0.0) * d * 1e-14).sum())
    found.values, found.components = values[:real], components[:, :real]
    if real:
        def make(x: np.ndarray) -> np.ndarray:
            w = found.whitened(x)
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

        sent = sums(rows, make) / n
        mean, square = sent[:real], sent[real:].reshape(real, real)
        found.identity_error = float(np.abs(square - np.outer(mean, mean) - np.eye(real)).max())
    return found


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, wanted: int = 8, key: str = "vec_id", vector: str = "embedding", seed: int = SEED) -> DataFrame:
    """Rows of SCHEMA: each vector's coordinates on the leading components, scaled to variance one."""
    rows = rows_of(vectors, key, vector)
    found = fit(rows, wanted, seed)
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], SCHEMA)
    k = len(found.values)
    explained = found.values / found.trace if found.trace and math.isfinite(found.trace) else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches):
            n = len(x)
            each = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, found.n)),
                    pa.array(found.deviation(x), pa.int64()).take(each),
                    pa.array(found.whitened(x).ravel()),
                    pa.array(np.tile(explained, n)),
                    pa.array(np.full(n * k, found.identity_error)),
                ],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    return rows.mapInArrow(run, SCHEMA)
