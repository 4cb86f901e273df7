"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Components are never sought in a matrix of covariances: every step is one distributed
pass that multiplies the centred data and its transpose with a narrow block, XᵀXQ, and
sums blocks of dimension x block width. A polynomial of those passes, in Chebyshev's
recurrence over the interval of the unwanted values, damps everything below the block;
QR and Rayleigh-Ritz follow, until the residuals of all wanted pairs are at rounding
level. The answer is then certified: the block's guard columns are drawn anew and
another round must find the same leading values, so no direction was missed.

The fit uses each distinct grid vector once, x = floor(64 c) + 1000000 as integers.
Sums are exact; centring takes the integer part of the mean first, so no digits are
lost to the offset. The driver holds blocks of dimension x width only.

Cases: vectors that are null, empty, or hold null or non-finite entries are dropped, and
so are those whose length is not the commonest one (the longer of equally common);
entries beyond 2^46 count as that; components whose value is zero at rounding level
(constant or dependent dimensions, fewer vectors than dimensions) are left out, so a
table of one distinct vector gives no rows; repeated rows and null ids are rows of their
own; equal values give components in any rotation; a deviation beyond 64 bits is null;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.common import written

GRID, OFFSET = 64, 1_000_000
COMPONENTS, GUARD, DEGREE = 16, 12, 8
ROUNDS = 200
_HALF = 26                                  # bits of an entry's lower part while summing
_EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Whitening:
    """A fit: count, exact sums, components (columns), their values, trace, and the largest error of the identity."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))


def grid_vectors(rows: DataFrame, column: str = "embedding", ident: str = "vec_id") -> tuple[DataFrame, int]:
    """(vec_id, x) of all usable rows, and the dimension."""
    v = F.transform(F.col(column), lambda c: c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    most = float(1 << 52)
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * GRID, F.lit(most)), F.lit(-most))).cast("long") + OFFSET)
    good = rows.select(F.col(ident).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    lengths = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    return good.where(F.size("v") == d).select("vec_id", x.alias("x")), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _total(fit: DataFrame, d: int, block: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum of ``block`` over all vectors: summed in each task, then by slot."""
    def work(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = block(_matrix(batch.column(0), d)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["slot", "value"])
    rows = fit.select("x").mapInArrow(work, f"slot long, value {kind}").groupBy("slot").agg(F.sum("value").alias("value")).collect()     # d x width rows
    return np.array([r["value"] for r in sorted(rows, key=lambda r: r["slot"])])


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Count and exact sums of the dimensions."""
    def parts(x):
        return np.concatenate([[len(x)], (x >> _HALF).sum(0), (x & ((1 << _HALF) - 1)).sum(0)])
    t = [int(v) for v in _total(fit, d, parts, "long")]
    return (t[0], [(h << _HALF) + low for h, low in zip(t[1:d + 1], t[d + 1:])]) if t else (0, [])


def _ritz(q: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (falling), vectors and their products within an orthonormal block."""
    h = q.T @ product
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, product @ turn


def _filtered(times: Callable, q: np.ndarray, product: np.ndarray, values: np.ndarray, degree: int) -> np.ndarray:
    """Chebyshev's polynomial over [0, smallest value of the block], scaled by its size at the largest."""
    centre = half = max(values[-1], values[0] * _EPS) / 2
    first = sigma = half / (values[0] - centre)
    before, now = q, (product - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (times(now) - centre * now) * (2 * following / half) - (sigma * following) * before
        sigma = following
    return now


def leading(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, guard: int = GUARD, degree: int = DEGREE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their vectors of a symmetric positive operator given by its products."""
    rng = np.random.default_rng(12)
    width = min(d, k + guard)
    k = min(k, d)
    q = np.eye(d) if width == d else np.linalg.qr(rng.standard_normal((d, width)))[0]
    values, q, product = _ritz(q, times(q))
    if width == d or values[0] <= 0:
        return values[:k], q[:, :k]
    best, worse, known = np.inf, 0, None
    for _ in range(rounds):
        residual = np.linalg.norm(product - q * values, axis=0)[:k].max() / values[0]
        worse = 0 if residual < best / 2 else worse + 1
        best = min(best, residual)
        if residual <= 16 * _EPS or (worse >= 2 and residual <= 1e-13):
            if known is not None and np.allclose(values[:k], known, rtol=0, atol=1e-12 * values[0]):
                return values[:k], q[:, :k]
            known, best, worse = values[:k].copy(), np.inf, 0
            fresh = np.linalg.qr(np.c_[q[:, :k], rng.standard_normal((d, width - k))])[0]
            low, q, product = _ritz(fresh, times(fresh))
            values = np.r_[low[:-1], min(low[-1], values[-1])]       # the interval must not reach what is wanted
        q = np.linalg.qr(_filtered(times, q, product, values, degree))[0]
        values, q, product = _ritz(q, times(q))
    raise ArithmeticError(f"no certified components after {rounds} rounds, residual {best:.1e}")


def fitted(x: DataFrame, d: int, k: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``x``; None without a component."""
    fit = written(x.select("x").distinct())
    n, sums = _sums(fit, d)
    if n < 2:
        return None
    start = Whitening(n, sums, np.eye(d), np.ones(d), 1.0, 0.0)
    trace = float(_total(fit, d, lambda m: np.array([(start.centred(m) ** 2).sum()]))[0]) / n

    def times(q):
        def product(m):
            c = start.centred(m)
            return c.T @ (c @ q)
        return _total(fit, d, product).reshape(q.shape) / n
    values, vectors = leading(times, d, k)
    held = values > values[0] * d * 8 * _EPS
    if not held.any():
        return None
    values, vectors = values[held], vectors[:, held]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    model = Whitening(n, sums, vectors, values, trace, 0.0)
    k = len(values)

    def moments(m):
        w = model.whitened(m)
        return np.r_[w.sum(0), (w.T @ w).ravel()]
    t = _total(fit, d, moments) / n
    covariance = t[k:].reshape(k, k) - np.outer(t[:k], t[:k])
    return Whitening(n, sums, vectors, values, trace, float(np.abs(covariance - np.eye(k)).max()))


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sums of (n x - S)² over the dimensions, exactly."""
    near = x - model.base
    largest = model.n * (int(np.abs(near).max(initial=0)) + 1)
    if largest ** 2 * x.shape[1] < 1 << 62:
        return ((model.n * near - model.rest) ** 2).sum(1).tolist()
    exact = [sum((model.n * int(v) - int(r)) ** 2 for v, r in zip(row, model.rest)) for row in near]
    return [v if v < 1 << 63 else None for v in exact]


def scored(x: DataFrame, model: Whitening) -> DataFrame:
    """A row per vector and component: its whitened coordinate and what holds for the fit."""
    d, k = len(model.sums), len(model.values)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def work(batches):
        for batch in batches:
            m = _matrix(batch.column(1), d)
            rows = len(m)
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)),
                 pa.array(deviations(m, model), pa.int64()).take(pa.array(each)), pa.array(model.whitened(m).ravel()),
                 pa.array(np.tile(model.values / model.trace, rows)), pa.array(np.full(rows * k, model.identity_error))], names)
    return x.select("vec_id", "x").mapInArrow(work, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitening(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Fit on the distinct vectors of a table, and every usable row's whitened coordinates."""
    x, d = grid_vectors(embeddings)
    model = fitted(x, d, k) if d else None
    if model is None:
        model = Whitening(1, [0] * max(d, 1), np.zeros((max(d, 1), 0)), np.zeros(0), 1.0, 0.0)
        x = x.limit(0)
    return scored(x, model)
