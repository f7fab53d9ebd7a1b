"""Whitening of embeddings on their leading principal components, found by spectrum slicing.

Statistics of all vectors come from three scans, each one partial aggregate of bounded size per task:
exact integer sums; the products of the vectors centred by them; the covariance of the result.
The covariance is as wide as the vectors, whatever the number of rows, so its eigenpairs are found on
the driver:

1. The inertia of an LDL' factorisation of V - s counts the eigenvalues above s (Sylvester). Bisection
   on that count slices the spectrum until each leading eigenvalue stands alone in its interval.
2. Rayleigh quotient iteration from a few inverse iterations inside the interval converges cubically.
3. Counts on both sides of the value found certify its number; where they disagree, the interval is
   bisected further and the iteration starts anew. Eigenvalues that agree to double precision cannot
   be told apart: they get an orthonormal basis of their space, in any order.

Vectors that are null or hold a null, NaN or infinite entry are left out, and so are entries beyond
2**40 (their scaled value would lose digits), and vectors whose length is not the most frequent one
(of equally frequent ones the greatest). Components without variance (in fewer vectors than components,
or in constant ones) cannot be whitened and give no rows; no vectors, no rows. Repeated rows and null
ids are rows like others. Only the id and the vector are looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorquery.session import ship_functions

SCALE, SHIFT = 1024, 100000
COMPONENTS = 8
_LARGEST = float(1 << 40)
_BLOCK = 4096  # vectors worked on at a time
_BLOCK_ROWS = 32  # of the factorisation


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, x): vectors that can be scaled, as whole numbers."""
    entry = F.col(column).cast("array<double>")
    sound = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(_LARGEST)))
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entry.alias("entry")).where(
        F.col("entry").isNotNull() & F.coalesce(sound, F.lit(False)))
    return found.select("vec_id", F.transform("entry", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(batch, name: str = "x") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _pieces(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            yield batch.slice(at, _BLOCK)


def _sums(batches):
    """Exact sums of blocks of vectors: entries are below 2**50, so no sum of a block reaches 2**63."""
    import pyarrow as pa

    for piece in _pieces(batches):
        yield pa.RecordBatch.from_arrays([pa.array([_matrix(piece).sum(axis=0).tolist()], pa.list_(pa.int64()))], ["sums"])


def _products(centre: np.ndarray, map_rows=None):
    """Per task, the summed products of the centred vectors (of ``map_rows`` of them), and their sum."""

    def run(batches):
        import pyarrow as pa

        total = None
        for piece in _pieces(batches):
            rows = _matrix(piece) - centre
            rows = rows if map_rows is None else rows @ map_rows
            part = np.vstack([rows.T @ rows, rows.sum(axis=0)])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["row", "sums"])

    return run


def _covariance(rows: DataFrame, n: int, centre: np.ndarray, map_rows=None) -> np.ndarray:
    """Covariance (divisor n) of the centred vectors: as many numbers as the matrix has come back."""
    parts = rows.mapInArrow(_products(centre, map_rows), "row int, sums array<double>")
    added = parts.select("row", F.posexplode("sums").alias("col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v"))
    width = centre.size if map_rows is None else map_rows.shape[1]
    total = np.zeros((width + 1, width))
    for r in added.collect():  # (width + 1) * width numbers, whatever the number of vectors
        total[r["row"], r["col"]] = r["v"]
    mean = total[-1] / n
    found = total[:-1] / n - np.outer(mean, mean)
    return (found + found.T) / 2


# -- spectrum slicing ------------------------------------------------------------------------


def _pivoted(matrix: np.ndarray, scale: float) -> int:
    """Positive eigenvalues by LDL' with pivots of one or two rows (the larger of diagonal and
    off-diagonal decides, which bounds the growth)."""
    a, positive = matrix, 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        q, r = np.unravel_index(int(off.argmax()), off.shape)
        if max(diagonal[p], off[q, r]) <= 1e-18 * scale:
            return positive
        if diagonal[p] >= 0.6404 * off[q, r]:  # (1 + sqrt 17) / 8
            take = [p]
            positive += int(a[p, p] > 0)
        else:
            take = [int(q), int(r)]
            positive += 1  # the off-diagonal outweighs both: one positive and one negative root
        rest = np.setdiff1d(np.arange(len(a)), take)
        side = a[np.ix_(rest, take)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(take, take)], side.T)
        a = (a + a.T) / 2
    return positive


def inertia(matrix: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix: an LDL' factorisation by blocks, whose inertias add
    up. Where a block is nearly singular, what is left is factored with pivots instead."""
    scale = np.abs(matrix).max(initial=0.0)
    a, positive = matrix, 0
    while len(a) > _BLOCK_ROWS:
        head, side = a[:_BLOCK_ROWS, :_BLOCK_ROWS], a[_BLOCK_ROWS:, :_BLOCK_ROWS]
        if np.linalg.cond(head) > 1e6 or np.abs(head).max() < 1e-6 * scale:
            break
        positive += _pivoted(head, scale)
        a = a[_BLOCK_ROWS:, _BLOCK_ROWS:] - side @ np.linalg.solve(head, side.T)
        a = (a + a.T) / 2
    return positive + _pivoted(a, scale)


def above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues greater than ``shift``."""
    return inertia(matrix - shift * np.eye(len(matrix)))


def _isolate(matrix: np.ndarray, number: int, low: float, high: float, tight: float) -> tuple[float, float, int]:
    """(low, high, eigenvalues between): bisection until eigenvalue ``number`` (1 is the largest) stands
    alone, or the interval is no wider than ``tight``."""
    over, under = above(matrix, high), above(matrix, low)
    while high - low > tight and not (over == number - 1 and under == number and high - low < 1e-3 * max(high, tight)):
        middle = (low + high) / 2
        count = above(matrix, middle)
        if count >= number:
            low, under = middle, count
        else:
            high, over = middle, count
    return low, high, under - over


def _refine(matrix: np.ndarray, low: float, high: float, known: np.ndarray, seed: int) -> tuple[float, np.ndarray]:
    """An eigenpair near the interval: inverse iteration at its middle, then the shift follows the
    Rayleigh quotient. ``known``: columns that the vector is kept orthogonal to."""
    size = len(matrix)

    def unit(x):
        for _ in range(2):
            x = x - known @ (known.T @ x)
        return x / np.linalg.norm(x)

    def step(shift, x):
        for nudge in (0.0, 1e-15, 1e-14, 1e-13):
            try:
                y = np.linalg.solve(matrix - (shift + nudge * max(abs(high), 1.0)) * np.eye(size), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all() and np.linalg.norm(y):
                return unit(y)
        return x

    x = unit(np.random.default_rng(seed).standard_normal(size))
    for _ in range(4):
        x = step((low + high) / 2, x)
    value = float(x @ matrix @ x)
    for _ in range(12):
        if not low <= value <= high:
            break
        y = step(value, x)
        nearer = float(y @ matrix @ y)
        done = np.linalg.norm(matrix @ y - nearer * y) >= 0.5 * np.linalg.norm(matrix @ x - value * x)
        x, value = y, nearer
        if done:
            break
    return value, x


def leading_pairs(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a covariance matrix, by falling value, at most ``most``
    and only those above what rounding makes of zero. The largest entry of a vector is positive."""
    size = len(matrix)
    bound = float(np.abs(matrix).sum(axis=1).max(initial=0.0))  # no eigenvalue is larger
    floor = size * np.finfo(float).eps * bound
    wanted = min(most, above(matrix, floor)) if bound else 0
    values, vectors = [], np.zeros((size, 0))
    while len(values) < wanted:
        number = len(values) + 1
        low, high, tight = 0.0, bound * (1 + 1e-9), floor
        while True:
            low, high, alike = _isolate(matrix, number, low, high, tight)
            value, vector = _refine(matrix, low, high, vectors, number)
            near = max(4 * floor, 1e-12 * abs(value))
            certain = above(matrix, value - near) >= number > above(matrix, value + near)
            if certain or high - low <= tight:
                break
            middle = (low + high) / 2  # the iteration ran to a neighbour: a narrower slice
            low, high = (middle, high) if above(matrix, middle) >= number else (low, middle)
        values.append(value)
        vector = vector if vector[np.abs(vector).argmax()] > 0 else -vector
        vectors = np.column_stack([vectors, vector])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[:, order]


# -- the table -------------------------------------------------------------------------------


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n x - S)**2 per vector, in whole numbers of any size."""
    if not len(x):
        return []
    low, high = x.min(axis=0).tolist(), x.max(axis=0).tolist()
    widest = max(max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(low, high, sums))
    largest = max(n * max(abs(a), abs(b)) for a, b in zip(low, high))
    small = widest * widest * len(sums) < 1 << 62 and max(largest, *map(abs, sums)) < 1 << 62
    kind = np.int64 if small else object
    apart = x.astype(kind) * n - np.array(sums, dtype=kind)
    return [int(v) for v in (apart * apart).sum(axis=1)]


def _whitened(n: int, sums: list[int], centre: np.ndarray, projection: np.ndarray, explained: list[float], error: float):
    k = len(explained)

    def run(batches):
        import decimal

        import pyarrow as pa

        with decimal.localcontext(prec=76):
            for piece in _pieces(batches):
                x = _matrix(piece)
                apart = pa.array(
                    [decimal.Decimal(v) if v < 10**38 else None for v in exact_deviation(x, n, sums)], pa.decimal128(38, 0))
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    piece.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, n), pa.int64()), apart.take(each),
                    pa.array(((x - centre) @ projection).ravel(), pa.float64()),
                    pa.array(np.tile(explained, m), pa.float64()), pa.array(np.full(m * k, error), pa.float64()),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


_WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and leading component: (vec_id, component, n, deviation, whitened,
    explained, identity_error). ``deviation`` is exact as a decimal of 38 digits (null beyond)."""
    spark = vectors.sparkSession
    found = usable(vectors, column)
    lengths = found.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("width")).first()
    if usual is None or not usual["width"]:
        return spark.createDataFrame([], _WHITENED)
    n, width = usual["rows"], usual["width"]
    rows = found.where(F.size("x") == width)
    parts = rows.mapInArrow(_sums, "sums array<long>").select(F.posexplode("sums").alias("i", "v"))
    added = parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in added.orderBy("i").collect()]  # one number per dimension
    centre = np.array([s / n for s in sums])
    covariance = _covariance(rows, n, centre)
    values, axes = leading_pairs(covariance, components)
    if not len(values):
        return spark.createDataFrame([], _WHITENED)
    projection = axes / np.sqrt(values)
    explained = (values / np.trace(covariance)).tolist()
    error = float(np.abs(_covariance(rows, n, centre, projection) - np.eye(len(values))).max())
    return rows.mapInArrow(_whitened(n, sums, centre, projection, explained, error), _WHITENED)


def as_long(column: str) -> Column:
    """A whole decimal as long; null beyond its range (ANSI mode or not)."""
    return F.expr(f"try_cast({column} AS long)")


ship_functions(__name__)
