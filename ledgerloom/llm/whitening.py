"""Embedding whitening by LOBPCG: distributed covariance-block products, Rayleigh-Ritz on the driver.

1. One pass gives n and the exact sums S of the whole-number vectors x (``quantise``).
2. ``Covariance.times`` multiplies the covariance with a block of columns: every task centres its rows
   before multiplying, (n * x - S) / n, and adds up D'(D B); partial blocks are summed by dimension. The
   covariance itself is never formed; a task and the driver hold dimensions x columns numbers.
3. ``lobpcg`` iterates on the orthonormal basis of iterate, residuals and previous directions. The product of
   the whole basis is taken anew each time, so that no error is carried along, until the residuals of the
   wanted pairs are below ``TOLERANCE`` of the largest eigenvalue; a last product of the final block certifies
   them, and what isn't certified raises.
4. One pass whitens the rows and measures how far their covariance is from the identity; the last
   writes a row a vector and component.

Every pass is a map over the rows with partial sums; there is no key that could be hot.
"""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
GUARD = 4
#: Residuals as a share of the largest eigenvalue: aimed at, and the most that is certified.
TOLERANCE, CERTIFIED = 1e-13, 1e-9
MOST_ITERATIONS = 300
#: Eigenvalues below this share of the largest are no variance; their components are left out.
RANK = 1e-12
_LONG = 2**63 - 1
_LARGEST = 2.0**62


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values, lengths, and which rows take part: present, not empty, all entries present and finite."""
    size = np.diff(column.offsets.to_numpy()).astype(np.int64)
    valid = np.asarray(column.is_valid())
    values = column.flatten()  # without the entries of null rows
    size = np.where(valid, size, 0)
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become nan
    bad = np.bincount(np.repeat(np.arange(len(size)), size), ~np.isfinite(flat), len(size))
    return flat, size, (size > 0) & (bad == 0)


def quantise(matrix: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1000000 as longs; beyond 2**62 entries count as that."""
    return np.clip(np.floor(SCALE * matrix), -_LARGEST, _LARGEST).astype(np.int64) + SHIFT


def blocks(batches, width: int | None):
    """(ids, x) of the rows of a width, batch by batch; of every width if it is None."""
    for batch in batches:
        flat, size, fit = vectors(batch.column(1))
        starts = np.cumsum(size) - size
        for w in np.unique(size[fit]) if width is None else [width]:
            rows = np.flatnonzero(fit & (size == w))
            if len(rows):
                x = quantise(flat[starts[rows][:, None] + np.arange(w)])
                yield batch.column(0).take(pa.array(rows)), x


class Centred:
    """n, the sums, and rows centred exactly before they become doubles."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.longs = np.array(sums, np.int64) if max(map(abs, sums)) < 2**61 else None

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as longs where they fit, else as Python's integers."""
        if self.longs is not None and int(np.abs(x).max(initial=0)) * self.n < 2**61:
            return x * np.int64(self.n) - self.longs
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (self.exact(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum of squares of n * x - S, exact; one beyond a long is given as the largest long."""
        d = self.exact(x)
        if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0**62:
            return (d * d).sum(1)
        d = d.astype(object)
        return np.array([min(_LONG, int(v)) for v in (d * d).sum(1)], np.int64)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def fit_sums(rows: DataFrame) -> tuple[int, list[int]] | None:
    """n and exact sums by dimension of the vectors of the commonest width (of equally common ones the widest)."""

    def run(batches):
        total: dict[int, tuple[int, np.ndarray]] = {}
        for _, x in blocks(batches, None):
            n, s = total.get(x.shape[1], (0, 0))
            total[x.shape[1]] = n + len(x), s + x.astype(object).sum(0) if np.abs(x).max() > 2**40 else s + x.sum(0).astype(object)
        for w, (n, s) in total.items():
            yield _batch({"width": np.full(w, w, np.int32), "dim": np.arange(w, dtype=np.int32), "n": np.full(w, n), "sum": pa.array([decimal.Decimal(int(v)) for v in s], pa.decimal128(38, 0))})

    sums = rows.mapInArrow(run, "width int, dim int, n long, sum decimal(38,0)").groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum("sum").cast("decimal(38,0)").alias("sum"))
    first = sums.where("dim = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if first is None:
        return None
    return first["n"], [int(r["sum"]) for r in sums.where(F.col("width") == first["width"]).orderBy("dim").collect()]


class Covariance:
    """V = D'D / n of the centred rows, known by its products."""

    def __init__(self, rows: DataFrame, centred: Centred) -> None:
        self.rows, self.centred, self.width = rows, centred, len(centred.sums)
        self.trace = 0.0

    def times(self, block: np.ndarray) -> np.ndarray:
        width, columns = block.shape
        shared = self.rows.sparkSession.sparkContext.broadcast((self.centred, block))

        def run(batches):
            centred, b = shared.value
            total, squares = np.zeros((width, columns)), np.zeros(width)
            some = False
            for _, x in blocks(batches, width):
                d = centred.rows(x)
                total += d.T @ (d @ b)
                squares += (d * d).sum(0)
                some = True
            if some:
                yield _batch({"dim": np.arange(width, dtype=np.int32), "square": squares, "v": pa.ListArray.from_arrays(np.arange(0, width * columns + 1, columns, dtype=np.int32), pa.array(total.ravel()))})

        parts = self.rows.mapInArrow(run, "dim int, square double, v array<double>")
        got = parts.groupBy("dim").agg(F.sum("square").alias("square"), F.array(*(F.sum(F.col("v")[j]) for j in range(columns))).alias("v")).orderBy("dim").collect()
        shared.unpersist()
        self.trace = sum(r["square"] for r in got) / self.centred.n
        return np.array([r["v"] for r in got]) / self.centred.n


def orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of the block's part outside ``against``; directions of no length are dropped."""
    for _ in range(2):  # once more cleans what rounding left
        if against is not None:
            block = block - against @ (against.T @ block)
        norms = np.sqrt((block * block).sum(0))
        block = block[:, norms > 0] / norms[norms > 0]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8 * s[0]]
    return block


def lobpcg(covariance: Covariance, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns, with certified residuals."""
    width = covariance.width
    size = min(width, wanted + GUARD)
    x = orthonormal(np.random.default_rng(seed).standard_normal((width, size)))
    residual = previous = np.zeros((width, 0))
    best, since = np.inf, 0
    for _ in range(MOST_ITERATIONS):
        basis = x
        for more in (residual, previous):
            if more.shape[1] and basis.shape[1] < width:
                basis = np.hstack([basis, orthonormal(more, basis)])
        product = covariance.times(basis)
        small = basis.T @ product
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1][:size], y[:, ::-1][:, :size]
        old = x.shape[1]
        x, previous = basis @ y, basis[:, old:] @ y[old:]
        residual = product @ y - x * values
        worst = float(np.sqrt((residual[:, :wanted] ** 2).sum(0)).max())
        if worst <= TOLERANCE * values[0]:
            break
        since = 0 if worst < best / 2 else since + 1
        best = min(best, worst)
        if since >= 10 and best <= CERTIFIED * values[0]:
            break  # rounding keeps the residuals where they are
    u = x[:, :wanted]
    product = covariance.times(u)
    e = np.einsum("ij,ij->j", u, product)
    worst = float(np.sqrt(((product - u * e) ** 2).sum(0)).max())
    if worst > CERTIFIED * max(float(e.max()), 0.0):
        raise ArithmeticError(f"residual {worst / e.max():.1e} of the largest eigenvalue after {MOST_ITERATIONS} iterations")
    return e, u


def _identity_error(rows: DataFrame, centred: Centred, projection: np.ndarray) -> float:
    """Largest absolute entry of (the whitened rows' covariance - identity)."""
    width, k = projection.shape
    shared = rows.sparkSession.sparkContext.broadcast((centred, projection))

    def run(batches):
        c, p = shared.value
        total = np.zeros((k + 1, k))
        for _, x in blocks(batches, width):
            w = c.rows(x) @ p
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        yield _batch({"row": np.arange(k + 1, dtype=np.int32), "v": pa.ListArray.from_arrays(np.arange(0, (k + 1) * k + 1, k, dtype=np.int32), pa.array(total.ravel()))})

    parts = rows.mapInArrow(run, "row int, v array<double>")
    got = parts.groupBy("row").agg(F.array(*(F.sum(F.col("v")[j]) for j in range(k))).alias("v")).orderBy("row").collect()
    shared.unpersist()
    sums = np.array([r["v"] for r in got]) / centred.n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row a vector and component.

    Vectors that are null, empty, or hold null or non-finite entries take no part, nor do those of another width
    than most have. Components are numbered from 1 by falling eigenvalue; those without variance are left
    out, so that one vector alone, equal vectors and an empty table give no rows. Which of tied components
    comes first is arbitrary, but the same for all rows. Null ids stay null, repeated rows count each. Entries beyond 2**62 / 64
    count as that, deviations beyond a long as the largest one. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    found = fit_sums(rows)
    empty = spark.createDataFrame([], OUT)
    if found is None:
        return empty
    centred = Centred(*found)
    covariance = Covariance(rows, centred)
    if not covariance.times(np.zeros((covariance.width, 1))).size or covariance.trace <= 0:
        return empty
    trace = covariance.trace
    e, u = lobpcg(covariance, min(components, covariance.width))
    some = e > RANK * e[0]
    e, u = e[some], u[:, some]
    projection = u / np.sqrt(e)
    error, share, k, width, n = _identity_error(rows, centred, projection), e / trace, len(e), covariance.width, centred.n
    shared = spark.sparkContext.broadcast((centred, projection))

    def run(batches):
        c, p = shared.value
        for ids, x in blocks(batches, width):
            for at in range(0, len(x), 4096):
                part, mine = x[at : at + 4096], ids[at : at + 4096]
                m = len(part)
                yield _batch({
                    "vec_id": mine.take(pa.array(np.repeat(np.arange(m), k))), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": np.full(m * k, n, np.int64), "deviation": np.repeat(c.deviation(part), k),
                    "whitened": (c.rows(part) @ p).ravel(), "explained": np.tile(share, m), "identity_error": np.full(m * k, error),
                })

    return rows.mapInArrow(run, OUT)
