"""Whitening of embeddings with a weighted multiplicity covariance.

Entries become whole numbers, so equal vectors are found exactly. They are grouped into distinct vectors
with counts, and each distinct vector is read once per step, with its count (or one) as its weight:

1. sums of each dimension, as whole numbers;
2. weighted products of the centred vectors, one matrix product per batch (the covariance's upper
   triangle is all that reaches the driver: it grows with dimensions, never with rows);
3. the whitened vector and the exact deviation of each distinct vector;
4. the covariance of the whitened vectors, centred per task and merged, against the identity.

The result goes back to the rows by the name of their distinct vector. A vector that makes up more than
one in ``HOT_SHARE`` of all rows is joined by broadcast (there are fewer than ``HOT_SHARE`` of them), so no
task gets a large group of equal rows.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, as are entries that
do not fit a long after scaling; null ids stay, repeated rows stay and count as often; vectors of different
length are fitted apart; components without variance (below ``LEAST`` of the largest) are not returned, so a
single row or equal rows have an empty list; a deviation beyond a long is null. An empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import batches_of, lists, step, table

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 32
HOT_SHARE = 1000
LEAST = 1e-11
LONG = 2**63 - 1

SUMS = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("total", pa.decimal128(38, 0))])
PRODUCTS = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64())])
WHITE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("dim", pa.int32()), ("weight", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])
WHITE_DDL = "a long, b long, dim int, weight long, deviation long, whitened array<double>"

Fit = dict[int, tuple[int, list[int]]]


def whole_vectors(vectors: DataFrame, scale: float, shift: int, id_col: str, vector_col: str) -> DataFrame:
    """Rows that are fitted: ``id``, ``x`` and two hashes that name it."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))

    def fits(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < float(2**62))

    rows = rows.where(F.col("vector").isNotNull() & F.forall("vector", fits))
    rows = rows.select("id", F.transform("vector", lambda c: F.floor(c * scale) + F.lit(shift).cast("long")).alias("x"))
    return rows.select("id", F.xxhash64("x").alias("a"), F.xxhash64(F.lit(1), "x").alias("b"), "x")


def _groups(batch: pa.RecordBatch, dim: int, x: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and vectors of each length in a batch."""
    dims = np.asarray(batch.column(dim))
    for d in np.unique(dims).tolist():
        mine = np.flatnonzero(dims == d)
        yield d, mine, lists(batch.column(x).take(pa.array(mine)))[1].reshape(len(mine), d)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums of each dimension, exact."""
    totals: dict[int, list[int]] = {}
    for batch in batches:
        for dim, mine, x in _groups(batch, 1, 2):
            weight = np.asarray(batch.column(0))[mine]
            safe = len(mine) * float(np.abs(x).max(initial=0)) * float(weight.max()) < 2**62
            part = (x if safe else x.astype(object)).T @ (weight if safe else weight.astype(object))
            old = totals.get(dim, [0] * dim)
            totals[dim] = [int(o) + int(p) for o, p in zip(old, part, strict=True)]
    for dim, sums in totals.items():
        yield table({"dim": [dim] * dim, "i": range(dim), "total": sums}, SUMS)


def centred(x: np.ndarray, fit: tuple[int, list[int]]) -> tuple[np.ndarray, list[int | None]]:
    """x less the mean, and the sum of squares of n x - S of each vector (None beyond a long)."""
    n, sums = fit
    top = max(map(abs, sums), default=0)
    if n * float(np.abs(x).max(initial=0)) + top < 2**62:
        numerator = x * n - np.array(sums, np.int64)
        if float(np.abs(numerator).max(initial=0)) ** 2 * x.shape[1] < 2**62:
            return numerator / n, (numerator**2).sum(1).tolist()
        numerator = numerator.astype(object)
    else:
        numerator = x.astype(object) * n - np.array(sums, object)
    squares = [sum(v * v for v in row) for row in numerator.tolist()]
    return np.array([[v / n for v in row] for row in numerator.tolist()], float).reshape(x.shape), [s if s <= LONG else None for s in squares]


def _triangle(products: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for dim, total in products.items():
        i, j = np.triu_indices(len(total))
        yield table({"dim": np.full(len(i), dim), "i": i, "j": j, "total": total[i, j]}, PRODUCTS)


def _products(fits: Fit) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, mine, x in _groups(batch, 1, 2):
                c = centred(x, fits[dim])[0]
                total[dim] = total.get(dim, 0) + (c * np.asarray(batch.column(0))[mine][:, None]).T @ c
        yield from _triangle(total)
    return run


def _whiten(fits: Fit, matrices: dict[int, np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, mine, x in _groups(batch, 1, 2):
                c, deviation = centred(x, fits[dim])
                a, b, weight = (np.asarray(batch.column(name))[mine] for name in ("a", "b", "weight"))
                yield table({"a": a, "b": b, "dim": np.full(len(mine), dim), "weight": weight, "deviation": deviation, "whitened": list(c @ matrices[dim])}, WHITE)
    return run


def _spread(widths: dict[int, int]) -> Callable:
    """Products of whitened vectors about the task's own mean; column -1 holds the weighted sums, and (-1, -1) the weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims).tolist():
                mine, k = np.flatnonzero(dims == dim), widths[dim]
                w = np.asarray(batch.column(0))[mine].astype(float)
                z = lists(batch.column(2).take(pa.array(mine)))[1].reshape(len(mine), k)
                mean = w @ z / w.sum()
                new = (w.sum(), mean, ((z - mean) * w[:, None]).T @ (z - mean))
                if dim in state:
                    n, old, products = state[dim]
                    both, apart = n + new[0], new[1] - old
                    new = (both, old + apart * (new[0] / both), products + new[2] + np.outer(apart, apart) * (n * new[0] / both))
                state[dim] = new
        for dim, (n, mean, products) in state.items():
            i, j = np.triu_indices(len(mean))
            # About zero: products of the mean are added here and taken off once, after the sum over tasks.
            about_zero = products[i, j] + n * mean[i] * mean[j]
            yield table({"dim": np.full(len(i), dim), "i": i, "j": j, "total": about_zero}, PRODUCTS)
            edge = np.append(-1, np.arange(len(mean)))
            yield table({"dim": np.full(len(edge), dim), "i": np.full(len(edge), -1), "j": edge, "total": np.append(n, n * mean)}, PRODUCTS)
    return run


def _collect_products(partial: DataFrame) -> dict[int, dict[tuple[int, int], float]]:
    out: dict[int, dict[tuple[int, int], float]] = {}
    for r in partial.groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).collect():  # dimensions squared
        out.setdefault(r["dim"], {})[r["i"], r["j"]] = r["total"]
    return out


def _square(entries: dict[tuple[int, int], float], size: int) -> np.ndarray:
    return np.array([[entries[min(i, j), max(i, j)] for j in range(size)] for i in range(size)]).reshape(size, size)


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns, largest entry positive) with variance."""
    if not covariance.size:
        return np.zeros(0), np.zeros((0, 0))
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    good = values > max(float(values[0]) * LEAST, 0.0)
    values, vectors = values[good], vectors[:, good]
    if not len(values):
        return values, vectors
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, counts: bool = True, scale: float = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row for each vector: id, ``n``, ``deviation``, ``whitened`` and ``explained`` (lists by component), ``identity_error``.

    With ``counts`` the fit weighs each distinct vector by its rows, else by one.
    """
    spark = vectors.sparkSession
    rows = step(whole_vectors(vectors, scale, shift, id_col, vector_col))
    distinct = rows.groupBy("a", "b", "x").agg(F.count(F.lit(1)).alias("copies"))
    distinct = step(distinct.select((F.col("copies") if counts else F.lit(1).cast("long")).alias("weight"), F.size("x").alias("dim"), "x", "a", "b", "copies"))
    sizes = {r["dim"]: r for r in distinct.groupBy("dim").agg(F.sum("weight").cast("long").alias("n"), F.sum("copies").alias("rows")).collect()}
    with batches_of(spark, 4096):
        sums: dict[int, list[int]] = {dim: [0] * dim for dim in sizes}
        partial = distinct.select("weight", "dim", "x").mapInArrow(_sums, "dim int, i int, total decimal(38,0)")
        for r in partial.groupBy("dim", "i").agg(F.sum("total").alias("total")).collect():  # one row for each dimension
            sums[r["dim"]][r["i"]] = int(r["total"])
        fits: Fit = {dim: (sizes[dim]["n"], sums[dim]) for dim in sizes}
        entries = _collect_products(distinct.select("weight", "dim", "x").mapInArrow(_products(fits), "dim int, i int, j int, total double"))
        matrices, report = {}, []
        traces = {}
        for dim, (n, _) in fits.items():
            covariance = _square(entries.get(dim, {}), dim) / n
            values, axes = components_of(covariance, components)
            matrices[dim], traces[dim] = axes / np.sqrt(values), (values, float(np.trace(covariance)))
        white = step(distinct.select("weight", "dim", "x", "a", "b").mapInArrow(_whiten(fits, matrices), WHITE_DDL))
        widths = {dim: matrix.shape[1] for dim, matrix in matrices.items()}
        spread = _collect_products(white.select("weight", "dim", "whitened").mapInArrow(_spread(widths), "dim int, i int, j int, total double"))
    for dim, (n, _) in fits.items():
        k, found = widths[dim], spread.get(dim, {})
        mean = np.array([found[-1, j] for j in range(k)]) / n
        error = np.abs(_square(found, k) / n - np.outer(mean, mean) - np.eye(k)).max(initial=0)
        values, trace = traces[dim]
        report.append((dim, n, (values / trace).tolist() if trace else [], float(error)))
    fitted = spark.createDataFrame(report, "dim int, n long, explained array<double>, identity_error double")  # one row for each length

    total = sum(r["rows"] for r in sizes.values())
    hot = distinct.where(F.col("copies") * HOT_SHARE > total).select("a", "b")  # fewer than HOT_SHARE rows
    result = white.select("a", "b", "dim", "deviation", "whitened")
    names = rows.select("id", "a", "b")
    often = names.join(F.broadcast(result.join(F.broadcast(hot), ["a", "b"])), ["a", "b"])
    rare = names.join(F.broadcast(hot), ["a", "b"], "left_anti").join(result.hint("merge"), ["a", "b"])
    out = often.unionByName(rare).join(F.broadcast(fitted), "dim")
    return out.select(F.col("id").alias(id_col), "n", "deviation", "whitened", "explained", "identity_error")
