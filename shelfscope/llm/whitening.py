"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance is never formed. A block of ``components + guard`` directions is multiplied by it in passes over the
vectors, each task adding up y(yᵀQ) for its centred vectors y. A three-term Chebyshev recurrence over such passes damps
everything below the smallest Ritz value of the block and lifts what is above; QR and Rayleigh-Ritz follow, until the
residuals of all wanted pairs are certified. What reaches the driver has the size of the block, not of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.scratch import written

LARGEST = float(1 << 40)  # entries are cut to this size, so that whole numbers stay exact in doubles and in sums


@dataclass(frozen=True)
class Whitening:
    """``components``: most components. ``guard``: further directions in the block; with them the wanted part settles
    sooner. ``degree``: passes in a filter. ``tolerance``: residual to certify, as a share of the largest eigenvalue.
    ``rounds``: filters after which an uncertified block is refused. ``scale`` and ``offset`` make the whole numbers.
    """

    components: int = 32
    guard: int = 16
    degree: int = 10
    tolerance: float = 2e-14
    rounds: int = 60
    scale: float = 64.0
    offset: int = 1_000_000


@dataclass(frozen=True)
class Fitted:
    """``shift``: per-dimension sums of the whole numbers without the offset. ``axes``: columns are unit eigenvectors."""

    n: int
    shift: np.ndarray
    eigenvalues: np.ndarray
    axes: np.ndarray
    trace: float
    residual: float
    passes: int


def _rows_of(batch: pa.RecordBatch, place: int) -> np.ndarray:
    """The vectors of a batch as a matrix of longs."""
    column = batch.column(place)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, shift: np.ndarray) -> np.ndarray:
    """x minus the mean, rounded once: the mean is split into a whole part and a rest."""
    whole = shift // n
    return (x - whole).astype(np.float64) - (shift - whole * n) / n


def whole_numbers(vectors: DataFrame, rule: Whitening, vector_col: str) -> DataFrame:
    """``row`` and ``x`` (array<long>, floor of the scaled entries) of the vectors that count."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = lambda c: F.floor(F.greatest(F.least(c.cast("double") * rule.scale, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long")
    row = F.struct(*[vectors[c] for c in vectors.columns]).alias("row")
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & finite).select(row, F.transform(v, whole).alias("x"))


def _width(rows: DataFrame) -> int:
    """The length that most vectors have, of equally frequent ones the smallest; 0 for no rows."""
    counts = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max(F.struct("n", -F.col("d"))).alias("best")).first().best
    return -best[1] if best else 0


def _summed(rows: DataFrame, cells: int, add, dtype: type = np.float64) -> np.ndarray:
    """``add`` gives an array of ``cells`` numbers for each matrix of rows; added up in tasks, then over them by cell."""
    kind = "double" if dtype is np.float64 else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype)
        for batch in batches:
            if len(batch.column(0)):
                total += add(_rows_of(batch, 0))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["cell", "v"])

    v = F.col("v") if dtype is np.float64 else F.col("v").cast("decimal(38,0)")
    got = rows.select("x").mapInArrow(run, f"cell long, v {kind}").groupBy("cell").agg(F.sum(v).alias("v")).collect()
    if dtype is np.float64:
        total = np.zeros(cells)
        total[[r.cell for r in got]] = [r.v for r in got]
        return total
    return np.array([{r.cell: int(r.v) for r in got}.get(i, 0) for i in range(cells)], dtype=object)


def _counts(rows: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sums per dimension."""
    sums = _summed(rows, width + 1, lambda x: np.concatenate([x.sum(axis=0), [len(x)]]), np.int64)
    return int(sums[-1]), np.array([int(s) for s in sums[:-1]], dtype=np.int64)


class _Passes:
    """Products of the covariance with a block, one job each."""

    def __init__(self, rows: DataFrame, n: int, shift: np.ndarray):
        self.rows, self.n, self.shift, self.made = rows, n, shift, 0

    def times(self, q: np.ndarray) -> np.ndarray:
        n, shift = self.n, self.shift

        def add(x: np.ndarray) -> np.ndarray:
            y = _centred(x, n, shift)
            return (y.T @ (y @ q)).ravel()

        self.made += 1
        return _summed(self.rows, q.size, add).reshape(q.shape) / n

    def trace(self) -> float:
        n, shift = self.n, self.shift
        return float(_summed(self.rows, 1, lambda x: np.array([np.square(_centred(x, n, shift)).sum()]))[0]) / n


def _rayleigh_ritz(q: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values in falling order, with the block and its product turned to the Ritz vectors."""
    h = q.T @ z
    theta, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return theta[::-1], q @ turn, z @ turn


def _filtered(passes: _Passes, q: np.ndarray, z: np.ndarray, high: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of the covariance that stays small on [0, high], scaled to 1 near ``top``, times q.

    ``z`` is the product with q from the last Rayleigh-Ritz step, so a filter takes ``degree - 1`` passes.
    """
    half = high / 2
    sigma = half / (top - half)
    first = sigma
    before, now = q, (z - half * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (passes.times(now) - half * now) * (2 * after / half) - (sigma * after) * before
        sigma = after
    return now


def fit(rows: DataFrame, width: int, rule: Whitening) -> Fitted:
    """The leading eigenpairs of the covariance of ``rows`` (x: array<long> of ``width`` entries)."""
    n, shift = _counts(rows, width)
    passes = _Passes(rows, n, shift)
    trace = passes.trace()
    block = min(width, rule.components + rule.guard)
    wanted = min(rule.components, width)
    q, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((width, block)))
    residual = 0.0
    theta, q, z = _rayleigh_ritz(q, passes.times(q))
    if trace > 0:
        best, stalled = np.inf, 0
        for _ in range(rule.rounds):
            if block < width:
                high = max(theta[-1], theta[0] * 1e-12)
                filtered = _filtered(passes, q, z, high, theta[0], rule.degree) if theta[0] > high else z
                q, _ = np.linalg.qr(filtered)
            else:
                q, _ = np.linalg.qr(q)
            theta, q, z = _rayleigh_ritz(q, passes.times(q))
            residual = float(np.linalg.norm(z - q * theta, axis=0)[:wanted].max() / theta[0])
            # Certified, or as far down as rounding lets it go.
            stalled = stalled + 1 if residual > best / 2 else 0
            best = min(best, residual)
            if residual <= rule.tolerance or (stalled >= 2 and residual <= 100 * rule.tolerance):
                break
        else:
            raise ArithmeticError(f"eigenpairs not certified: residual {residual:.1e} after {rule.rounds} filters")
    # Directions in which the vectors don't differ have no scale to bring to one.
    real = theta[:wanted] > max(theta[0], 0.0) * width * 1e-14
    return Fitted(n, shift, theta[:wanted][real], q[:, :wanted][:, real], trace, residual, passes.made)


def _identity_error(rows: DataFrame, fitted: Fitted) -> float:
    """Largest entry of the covariance of the whitened vectors minus the identity; one more pass."""
    k, n, shift = len(fitted.eigenvalues), fitted.n, fitted.shift
    to = fitted.axes / np.sqrt(fitted.eigenvalues)

    def add(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, shift) @ to
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    total = _summed(rows, k * k + k, add)
    mean = total[k * k :] / n
    return float(np.abs(total[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, rule: Whitening | None = None, vector_col: str = "embedding") -> DataFrame:
    """Per vector that counts and component: ``row`` (the whole input row), component, n, deviation, whitened,
    explained, identity_error.

    ``deviation`` is the exact sum over the dimensions of (n x - S)², a decimal without fraction; ``whitened`` the
    centred vector on the component over the root of its eigenvalue; ``explained`` the eigenvalue's share of the trace.

    Passes over the table: two for counts and trace, ``degree`` a filter, one for the identity; each moves a block of
    width times (components + guard) numbers a task, summed by cell.

    Defined cases: vectors that are null, empty, or hold a null or non-finite entry are left out, and so are those of
    another length than most have; entries are cut at ±2**40 after scaling; repeated rows and ids, and null ids,
    count and come out row by row; equal eigenvalues share an arbitrary basis, the same for all rows; components
    without variance are left out, so one row alone, equal rows and an empty table give no rows; columns of any name stay in ``row``.
    """
    rule = rule or Whitening()
    rows = whole_numbers(vectors, rule, vector_col)
    rows = written(rows, "vectors")
    width = _width(rows)
    rows = rows.filter(F.size("x") == width)
    columns: dict[str, Column | str] = {
        "component": "int", "n": "long", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double",
    }
    schema = ", ".join(f"{name} {kind}" for name, kind in columns.items())
    if not width:
        return rows.select("row", *[F.lit(None).cast(kind).alias(name) for name, kind in columns.items()]).limit(0)
    fitted = fit(rows, width, rule)
    k = len(fitted.eigenvalues)
    if not k:
        return rows.select("row", *[F.lit(None).cast(kind).alias(name) for name, kind in columns.items()]).limit(0)
    error = _identity_error(rows, fitted)
    n, shift = fitted.n, fitted.shift
    to = fitted.axes / np.sqrt(fitted.eigenvalues)
    explained = fitted.eigenvalues / fitted.trace
    digits = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch.column(0)), 1024):
                part = batch.slice(start, 1024)
                x = _rows_of(part, part.schema.get_field_index("x"))
                w = _centred(x, n, shift) @ to
                exact = _deviations(x, n, shift)
                m = len(x)
                at = np.repeat(np.arange(m), k)
                given = pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("row"))], ["row"]).take(pa.array(at))
                made = [
                    given.column(0), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array(exact, digits).take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(made, ["row", *columns])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {schema}")


def _deviations(x: np.ndarray, n: int, shift: np.ndarray) -> list:
    """Exact sums of (n x - S)² by row, in machine words where they provably fit."""
    reach = max(abs(int(x.min())), abs(int(x.max())), 1) * n + int(np.abs(shift).max())
    if reach * reach * x.shape[1] < 1 << 63:
        return np.square(n * x - shift).sum(axis=1).astype(object).tolist()
    return [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, shift.tolist(), strict=True)) for row in x.tolist()]
