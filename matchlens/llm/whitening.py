"""Embedding whitening by spectrum slicing.

Entries become integers first, so sums and covariance are exact whatever the order of tasks. The number of negative pivots of
V - s = L D L' is the number of eigenvalues below s (Sylvester's law of inertia): bisection by these counts isolates each
leading eigenvalue of the covariance V, Rayleigh quotient iteration converges to it cubically, and counts on both sides of
the result certify that it is the k-th one.

Spark makes the sums, the covariance, the projections and the covariance of the result; the driver sees d x d numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0 ** 31          # entries of this size or more would not stay exact
COMPONENTS = 8
CHUNK = 4096                 # rows of a product


# --- eigenvalues and eigenvectors of a symmetric matrix ------------------------------------------------------------------

_PIVOT = (1 + 17 ** 0.5) / 8


def below(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix are below the shift: negative eigenvalues of D in L D L' = matrix - shift.

    Pivots are single numbers or, where the diagonal is too small, blocks of two, of which one eigenvalue is negative.
    """
    a = matrix - shift * np.eye(len(matrix))
    count = 0
    while len(a):
        column = np.abs(a[1:, 0])
        largest = column.max(initial=0.0)
        if largest == 0:
            count += int(a[0, 0] < 0)
            a = a[1:, 1:]
            continue
        other = int(column.argmax()) + 1
        beside = np.abs(a[:, other])
        beside[other] = 0
        if abs(a[0, 0]) * beside.max() >= _PIVOT * largest ** 2:
            order = None
        elif abs(a[other, other]) >= _PIVOT * beside.max():
            order, other = [other], 0
        else:
            order = [0, other]
        if order is not None:
            rest = np.setdiff1d(np.arange(len(a)), order)
            order = np.concatenate([order, rest]).astype(int)
            a = a[np.ix_(order, order)]
        if order is None or other == 0:
            count += int(a[0, 0] < 0)
            a = a[1:, 1:] - np.outer(a[1:, 0], a[0, 1:] / a[0, 0])
        else:
            count += int((np.linalg.eigvalsh(a[:2, :2]) < 0).sum())
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
        a = (a + a.T) / 2
    return count


def _solve(matrix: np.ndarray, shift: float, vector: np.ndarray) -> np.ndarray:
    try:
        out = np.linalg.solve(matrix - shift * np.eye(len(matrix)), vector)
        if np.isfinite(out).all():
            return out
    except np.linalg.LinAlgError:
        pass
    # The shift is an eigenvalue to the last bit: one next to it gives the vector as well.
    return np.linalg.solve(matrix - (shift + np.abs(matrix).max() * 1e-15 + 1e-300) * np.eye(len(matrix)), vector)


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns; values of no more than rounding size are left out.

    Eigenvalues closer than rounding can't be isolated: their vectors are kept orthogonal to each other.
    """
    d = len(matrix)
    size = float(np.abs(matrix).sum(axis=1).max(initial=0.0))            # no eigenvalue is larger
    rounding = max(size, 1e-300) * d * 2.0 ** -52
    bounds: list[tuple[float, int]] = [(-size - rounding, 0), (size + rounding, d)]   # shift, eigenvalues below it

    def count(shift: float) -> int:
        n = below(matrix, shift)
        bounds.append((shift, n))
        return n
    values: list[float] = []
    vectors = np.zeros((d, 0))
    random = np.random.default_rng(0)
    for number in range(min(k, d)):
        rank = d - number - 1                                            # eigenvalues below the wanted one
        low = max(s for s, n in bounds if n <= rank)
        high = min(s for s, n in bounds if n > rank)
        while True:
            alone = any(s == low and n == rank for s, n in bounds) and any(s == high and n == rank + 1 for s, n in bounds)
            if alone or high - low <= rounding:
                found = _rayleigh(matrix, low, high, vectors, random, rounding)
                if found is not None or high - low <= rounding:
                    break
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) <= rank else (low, middle)
        value, vector = found if found is not None else ((low + high) / 2, _rayleigh_start(matrix, (low + high) / 2, vectors, random))
        # Counts beside the value certify its number.
        if not (below(matrix, value - 4 * rounding) <= rank < below(matrix, value + 4 * rounding)):
            raise ArithmeticError(f"eigenvalue {number + 1} was not found")
        if value <= 4 * rounding:
            break
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    return np.array(values), vectors


def _apart(vector: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    for _ in range(2):
        vector = vector - vectors @ (vectors.T @ vector)
        vector = vector / np.linalg.norm(vector)
    return vector


def _rayleigh_start(matrix: np.ndarray, shift: float, vectors: np.ndarray, random: np.random.Generator) -> np.ndarray:
    vector = _apart(random.standard_normal(len(matrix)), vectors)
    for _ in range(3):
        vector = _apart(_solve(matrix, shift, vector), vectors)
    return vector


def _rayleigh(matrix: np.ndarray, low: float, high: float, vectors: np.ndarray, random: np.random.Generator,
              rounding: float) -> tuple[float, np.ndarray] | None:
    """Eigenvalue and vector between the bounds, or None where the iteration leaves them: then they are cut further."""
    vector = _rayleigh_start(matrix, (low + high) / 2, vectors, random)
    for _ in range(12):
        value = float(vector @ matrix @ vector)
        if not low - rounding <= value <= high + rounding:
            return None
        if np.linalg.norm(matrix @ vector - value * vector) <= rounding:
            vector = _apart(_solve(matrix, value, vector), vectors)      # one more step: from rounding size to the last bits
            return float(vector @ matrix @ vector), vector * np.sign(vector[np.abs(vector).argmax()])
        vector = _apart(_solve(matrix, value, vector), vectors)
    return None


# --- Spark ------------------------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the vectors that take part; of several lengths the most frequent does (ties: the longest)."""
    vector = F.col("vector").cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vector").isNotNull() & (F.size("vector") > 0) & fine)
    usual = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vector") == (usual["d"] if usual else 0))


def _integers(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of an Arrow column as rows of integers."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def _summed(rows: DataFrame, name: str, function, d: int) -> dict[tuple[int, int], int]:
    """The sum over all tasks of the d x d (or 1 x d) tables of integers that function makes of blocks of rows."""
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = function(_integers(batch.slice(at, CHUNK).column("vector"), d))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                 pa.array([str(int(x)) for x in total.ravel()], pa.string())], ["i", "j", name])
    parts = rows.select("vector").mapInArrow(per_task, f"i int, j int, {name} string")
    whole = parts.groupBy("i", "j").agg(F.sum(F.col(name).cast("decimal(38,0)")).alias(name))
    return {(r["i"], r["j"]): int(r[name]) for r in whole.collect()}


def _products(x: np.ndarray) -> np.ndarray:
    """x' x, exactly: in double precision where no sum can pass 2^53, else in Python's integers."""
    if float(np.abs(x).max(initial=0)) ** 2 * len(x) < 2.0 ** 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    return x.astype(object).T @ x.astype(object)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per usable vector (vec_id, vector) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries, or entries of 2^31 or more, take no part, nor do those of
    an unusual length. An entry c becomes x = floor(1024 c) + 100000. Components are unit eigenvectors of the covariance of x (divisor n) by falling
    eigenvalue, each with its largest entry positive; there are fewer than asked for if the covariance has a smaller rank, none if all vectors are equal.
    deviation is the exact sum of (n x - S)^2 (null beyond a long), whitened the projection over the root of the eigenvalue, identity_error the largest
    entry of the covariance of whitened minus the identity, measured on the result. Repeated rows count as often as they stand there;
    a null vec_id stays null. Without vectors: no rows.
    """
    rows = usable(vectors)
    first = rows.first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if first is None:
        return rows.sparkSession.createDataFrame([], schema)
    d = len(first["vector"])
    sums = _summed(rows, "sums", lambda x: np.vstack([x.astype(object).sum(axis=0), np.full(d, len(x), object)]), d)
    n, total = sums[1, 0], [sums[0, j] for j in range(d)]
    centre = np.array([s // n for s in total], np.int64)
    left = [s - n * int(c) for s, c in zip(total, centre, strict=True)]   # sums of x - centre, below n each
    spread = _summed(rows, "products", lambda x: _products(x - centre), d)
    # n^2 V in whole numbers: centred before multiplying, divided once.
    covariance = np.array([[(n * spread[i, j] - left[i] * left[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, axes = leading(covariance, components)
    trace = sum(n * spread[i, i] - left[i] * left[i] for i in range(d)) / (n * n)
    if not len(values):
        return rows.sparkSession.createDataFrame([], schema)
    whole = np.array(total, object)
    scaled = axes / np.sqrt(values)

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - centre) - np.array(left, float) / n) @ scaled

    k = len(values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = projected(_integers(batch.column("vector"), d))
            total += np.vstack([w.sum(axis=0), w.T @ w])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "x"])
    found = rows.select("vector").mapInArrow(moments, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    whitened = np.zeros((k + 1, k))
    for r in found:
        whitened[r["i"], r["j"]] = r["x"] / n
    error = float(np.abs(whitened[1:] - np.outer(whitened[0], whitened[0]) - np.eye(k)).max())
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x = _integers(part.column("vector"), d)
                yield _result(part.column("vec_id"), x, projected(x))

    def _result(ids: pa.Array, x: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        m = len(x)
        far = float(np.abs(x - centre).max(initial=0) + 1) * n
        if far ** 2 * d < 2.0 ** 62:
            deviation = pa.array(((n * (x - centre) - np.array(left, np.int64)) ** 2).sum(axis=1))
        else:
            exact = ((n * x.astype(object) - whole) ** 2).sum(axis=1)
            deviation = pa.array([int(v) if v < 2 ** 63 else None for v in exact], pa.int64())
        each = pa.array(np.repeat(np.arange(m), k))
        return pa.RecordBatch.from_arrays(
            [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
             deviation.take(each), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(project, schema)
