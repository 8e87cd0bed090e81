"""Whitening by principal components, which contour integration finds (FEAST).

1. One pass adds up the vectors' sums, a second one their products about the integers nearest to the means. Both are exact integers, added up
   in tasks and then by Spark for each dimension or pair of dimensions, so the covariance is exact but for its last rounding. All that
   reaches the driver has the size of the covariance, whatever the number of vectors.
2. Inertia (the signs in a symmetric factorisation of the covariance minus a shift) counts the eigenvalues below a shift. Bisection by such
   counts cuts the upper end of the spectrum into intervals of few eigenvalues each, whose ends keep away from eigenvalues.
3. Each interval is a task. Quadrature on a circle about it of the solutions of complex shifted systems projects a block of vectors onto the
   interval's eigenvectors; Rayleigh-Ritz in the projected block gives pairs; both are repeated until residuals are at rounding level. The
   pairs found have to be as many as the inertia at both ends says, or the block grows and starts again.
4. A pass projects the vectors and adds up their covariance, which has to be the identity; the last one returns the rows.

Defined results: a vector that is null, or holds null or non-finite entries, takes no part; a null id is carried along, and repeated rows
count as often as they occur. Vectors of unequal lengths are padded with zero entries. Components whose variance is no more than rounding (of
vectors that lie in fewer dimensions, or all alike) don't exist, and there are no rows for them. Extra columns are ignored. An empty table gives
an empty result. What doesn't fit the exact integers of 64 bits is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.llm.common import table, written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Eigenvalues of an interval at most (unless they are too close to part), quadrature nodes of a half circle, repetitions.
FEW, NODES, ROUNDS = 8, 8, 30
#: In units of the largest eigenvalue's bound: distance of an interval's end from eigenvalues, and what counts as no variance.
APART, NOTHING = 1e-9, 1e-13
ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# ---- eigenvectors of a symmetric matrix


def below(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are under a shift: the negative pivots of a symmetric factorisation with complete pivoting by single rows or pairs."""
    rest, count = matrix - shift * np.eye(len(matrix)), 0
    while len(rest):
        own, other = np.abs(rest.diagonal()), np.abs(rest - np.diag(rest.diagonal()))
        r, s = np.unravel_index(other.argmax(), rest.shape)
        if max(own.max(), other[r, s]) == 0:
            break
        pivot = [int(own.argmax())] if own.max() >= 0.64 * other[r, s] else [int(r), int(s)]
        block, stays = rest[np.ix_(pivot, pivot)], np.delete(np.arange(len(rest)), pivot)
        count += int(block[0, 0] < 0) if len(pivot) == 1 else 1  # a pair is taken only if its determinant is negative
        side = rest[np.ix_(stays, pivot)]
        rest = rest[np.ix_(stays, stays)] - side @ np.linalg.solve(block, side.T)
    return count


@dataclass(frozen=True)
class Interval:
    lo: float
    hi: float
    count: int


def intervals(matrix: np.ndarray, most: int) -> list[Interval]:
    """Intervals from the top of the spectrum down, until they have `most` eigenvalues or all that are above NOTHING; matrix has norm 1 at most."""
    size = len(matrix)

    def end(lo: float, hi: float) -> tuple[float, int] | None:
        """A place near the middle that no eigenvalue is near, and the eigenvalues under it."""
        for share in (0.5, 0.46, 0.55, 0.39, 0.63, 0.3, 0.71, 0.2, 0.8):
            at = lo + share * (hi - lo)
            if (n := below(matrix, at - APART)) == below(matrix, at + APART):
                return at, n
        return None

    lowest = below(matrix, NOTHING)
    wanted, out, open_ = min(most, size - lowest), [], [(NOTHING, 1.0 + 1e-6, lowest, size)]
    while open_ and sum(x.count for x in out) < wanted:
        lo, hi, under_lo, under_hi = open_.pop()
        if under_hi == under_lo:
            continue
        cut = end(lo, hi) if under_hi - under_lo > FEW and hi - lo > 8 * APART else None
        if cut is None:
            out.append(Interval(lo, hi, under_hi - under_lo))
        else:
            open_ += [(lo, cut[0], under_lo, cut[1]), (cut[0], hi, cut[1], under_hi)]
    return out


def pairs_of(matrix: np.ndarray, own: Interval, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues in an interval, with their unit eigenvectors as columns."""
    size, mid, radius = len(matrix), (own.lo + own.hi) / 2, (own.hi - own.lo) / 2
    node, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (node + 1))
    block = min(size, own.count + max(4, own.count // 2))
    while True:
        y = np.random.default_rng(seed).normal(size=(size, block))
        for _ in range(ROUNDS):
            if block < size:
                y = sum(w / 2 * radius * (t * np.linalg.solve((mid + radius * t) * np.eye(size) - matrix, y)).real for t, w in zip(turn, weight, strict=True))
            basis = np.linalg.qr(y)[0]
            value, small = np.linalg.eigh(basis.T @ matrix @ basis)
            y = basis @ small
            rest = np.linalg.norm(matrix @ y - y * value, axis=0)
            inside = (value > own.lo) & (value <= own.hi)
            found = inside & (rest < 1e-11)
            if found.sum() == own.count and rest[found].max(initial=0) < 4 * np.finfo(float).eps * np.sqrt(size):
                break
        if found.sum() == own.count:
            return value[found], y[:, found]
        if block == size:
            raise ArithmeticError(f"{found.sum()} eigenvalues found where there are {own.count}")
        block, seed = min(size, 2 * block), seed + 1


def components(spark: SparkSession, covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns. Intervals are solved by tasks."""
    norm = float(np.abs(covariance).sum(axis=1).max(initial=0))
    if not norm:
        return np.zeros(0), np.zeros((len(covariance), 0))
    matrix = covariance / norm
    own = intervals(matrix, most)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                value, vector = pairs_of(matrix, Interval(row.lo, row.hi, row.held), row.number)
                yield pd.DataFrame({"value": value, "vector": [v.tobytes() for v in vector.T]})

    rows = spark.createDataFrame([(k, x.lo, x.hi, x.count) for k, x in enumerate(own)], "number long, lo double, hi double, held long")
    found = rows.repartition(max(len(own), 1), "number").mapInPandas(solve, "value double, vector binary").toPandas()
    found = found.sort_values("value", ascending=False, kind="stable").head(most)
    vectors = np.array([np.frombuffer(v) for v in found["vector"]]).reshape(-1, len(matrix)).T
    return found["value"].to_numpy() * norm, vectors


# ---- vectors


def whole_vectors(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, v): floor(scale * c) + offset of each entry as the bytes of 64-bit numbers; a written table."""
    c = F.col("embedding")
    good = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    scaled = F.transform(c, lambda e: F.floor(e.cast("double") * scale).cast("long") + offset)

    @F.pandas_udf("binary")
    def packed(rows: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(r, "<i8").tobytes() for r in rows], dtype=object)

    return written(vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), packed(scaled).alias("v")))


def _matrix(rows: list[bytes], size: int, offset: int) -> np.ndarray:
    if all(len(r) == 8 * size for r in rows):
        return np.frombuffer(b"".join(rows), "<i8").reshape(-1, size)
    out = np.full((len(rows), size), offset, np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r) // 8] = np.frombuffer(r, "<i8")
    return out


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int, offset: int, kind: str) -> np.ndarray:
    """of(vectors), an array, added up over all vectors: in each task, then by Spark for each place in it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of(_matrix(batch.column(0).to_pylist(), size, offset))
                total = own if total is None else total + own
        if total is not None:
            values = [str(x) for x in total.ravel().tolist()] if kind == "string" else total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(values)], ["at", "value"])

    value = F.sum(F.col("value").cast("decimal(38,0)")) if kind == "string" else F.sum("value")
    found = rows.select("v").mapInArrow(add, f"at long, value {kind}").groupBy("at").agg(value.alias("value")).collect()
    shape = of(np.full((1, size), offset, np.int64)).shape
    out = np.zeros(int(np.prod(shape)), object if kind == "string" else float)
    for r in found:
        out[r["at"]] = int(r["value"]) if kind == "string" else r["value"]
    return out.reshape(shape)


def _products(centre: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of products about a centre, as Python's integers."""
    y = x - centre
    most = int(np.abs(y).max(initial=0))
    if most >= 1 << 31:
        raise ValueError("entries too far from their mean for exact integers")
    step = max(1, (1 << 62) // max(most * most, 1))
    parts = [y[i : i + step] for i in range(0, len(y), step)]
    return sum((p.T @ p).astype(object) for p in parts)


@dataclass(frozen=True)
class Fit:
    """What whitening has learned: rows, exact sums, eigenvalues falling with their eigenvectors as columns, and the covariance's trace."""

    n: int
    sums: np.ndarray
    value: np.ndarray
    vector: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums.tolist()), default=0)
        if reach >= 1 << 63:
            raise ValueError("too many vectors for exact integers of 64 bits")
        return self.n * x - self.sums.astype(np.int64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n) @ (self.vector / np.sqrt(self.value))


def fit(rows: DataFrame, most: int = COMPONENTS, offset: int = OFFSET) -> Fit:
    """The Fit of a written table (vec_id, v)."""
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("v")).alias("bytes")).first()
    n, size = shape["n"], (shape["bytes"] or 0) // 8
    if not n or not size:
        return Fit(n, np.zeros(size, object), np.zeros(0), np.zeros((size, 0)), 0.0)
    sums = _summed(rows, lambda x: x.astype(object).sum(axis=0), size, offset, "string")
    centre = np.array([(2 * s + n) // (2 * n) for s in sums.tolist()], np.int64)
    products = _summed(rows, lambda x: _products(centre, x), size, offset, "string")
    left = sums - n * centre.astype(object)
    exact = n * products - np.outer(left, left)
    covariance = np.array([[v / (n * n) for v in row] for row in exact.tolist()])
    value, vector = components(rows.sparkSession, covariance, most)
    return Fit(n, sums, value, vector, float(np.trace(covariance)))


def identity_error(rows: DataFrame, own: Fit, offset: int = OFFSET) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity; their means are zero, as they are exact deviations."""
    many = len(own.value)

    def products(x: np.ndarray) -> np.ndarray:
        w = own.whiten(x)
        return np.vstack((w.sum(axis=0), w.T @ w))

    sums = _summed(rows, products, len(own.sums), offset, "double") / own.n
    return float(np.abs(sums[1:] - np.outer(sums[0], sums[0]) - np.eye(many)).max(initial=0))


def whitened(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """ROWS of vectors (vec_id, embedding): each vector's whitened components up to `most`."""
    rows = whole_vectors(vectors, scale, offset)
    own = fit(rows, most, offset)
    many, size = len(own.value), len(own.sums)
    if not many:
        return rows.sparkSession.createDataFrame([], ROWS)
    error, explained = identity_error(rows, own, offset), own.value / own.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist(), size, offset)
            away = own.deviations(x)
            if size * int(np.abs(away).max(initial=0)) ** 2 >= 1 << 63:
                raise ValueError("deviations too large for exact integers of 64 bits")
            rows_, w = len(x), own.whiten(x)
            each = lambda v: pa.array(np.repeat(v, many))
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows_), many))), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), rows_)), each(np.full(rows_, own.n)),
                each((away * away).sum(axis=1)), pa.array(w.ravel()), pa.array(np.tile(explained, rows_)), each(np.full(rows_, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROWS.split(", ")])

    return rows.mapInArrow(project, ROWS)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
