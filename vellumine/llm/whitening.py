"""Whitening of vectors by matrix-free block subspace iteration.

The covariance V of the distinct vectors is never formed. Each pass over the table
gives XᵀX Q for a block Q of directions, on centred rows. QR takes from it what the
subspace doesn't span yet, Rayleigh-Ritz finds the best components of the whole subspace,
and the residuals ‖V u - e u‖ certify them; the next block is what the last pass added. A
subspace that has grown to ``WIDEST`` blocks starts anew from its best components. The
driver and each task hold dimensions x subspace numbers, never dimensions².

Entries become whole numbers, and n·x - S is exact, so centring loses nothing; n times
the mean is the sum S itself. A task adds up its rows' share of XᵀX Q by blocks of rows;
the shares are added by row of the product before anything goes to the driver.

Cases: vectors that are null or hold a null or non-finite entry are dropped, and so are
those with an entry of 2**40 or more, which whole numbers can't hold with their squares.
Repeated rows and copies count once in the fit and each get their own result. Null ids
stay null. Vectors of each length are fitted by themselves. Components whose variance
is zero (copies of one vector only, or fewer distinct vectors than dimensions) can't be
whitened and are left out; an empty table gives an empty result. ``deviation`` is null if
it exceeds a long. Columns beside key and vector aren't carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.shared import cut

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(2**40)
#: Directions of a block beyond the components asked for, largest subspace in blocks, most passes, residual by the largest eigenvalue that certifies.
SPARE, WIDEST, PASSES, RESIDUAL = 16, 8, 400, 1e-13
#: Variance by the largest under which a component counts as zero.
ZERO = 1e-11
ROWS_AT_ONCE = 4096


def whole_numbers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry c, as longs; null where an entry has none."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST))
    return F.when(good, F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long")))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(len(x), -1)


def _apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in longs where they hold it, else in Python's whole numbers."""
    if n * int(np.abs(x).max(initial=0)) < 2**62 and max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the difference is taken between whole numbers, so nothing cancels."""
    return (_apart(x, n, sums) / n).astype(np.float64)


def _added(fit: DataFrame, kind: str, columns: int, share) -> np.ndarray:
    """Sum over all tasks of ``share`` of a block of rows; added row by row of the result before the driver sees it."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = _rows(batch)
            for at in range(0, len(rows), ROWS_AT_ONCE):
                new = share(rows[at : at + ROWS_AT_ONCE])
                held = new if held is None else held + new
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held), dtype=np.int32)), *(pa.array(held[:, k].copy()) for k in range(columns))], ["i", *(f"y{k}" for k in range(columns))])

    schema = "i int, " + ", ".join(f"y{k} {kind}" for k in range(columns))
    got = fit.select("x").mapInArrow(of_task, schema).groupBy("i").agg(*(F.sum(f"y{k}") for k in range(columns))).collect()
    return np.array([row[1:] for row in sorted(got, key=lambda row: row["i"])], dtype=object if kind == "long" else np.float64)


def sums_of(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension, in two parts so that no part leaves a long."""

    def share(x: np.ndarray) -> np.ndarray:
        return np.vstack([np.stack([(x >> 20).sum(0), (x & (2**20 - 1)).sum(0)], 1), [[len(x), 0]]])

    got = _added(fit, "long", 2, share)
    return int(got[-1, 0]), [(int(high) << 20) + int(low) for high, low in got[:-1]]


def _product(fit: DataFrame, n: int, sums: list[int], block: np.ndarray) -> tuple[np.ndarray, float]:
    """Xᵀ(X block)/n over the centred rows, and the trace of XᵀX/n: one pass."""

    def share(x: np.ndarray) -> np.ndarray:
        y = _centred(x, n, sums)
        return np.vstack([y.T @ (y @ block), np.full((1, block.shape[1]), (y * y).sum())])

    got = _added(fit, "double", block.shape[1], share) / n
    return got[:-1], float(got[-1, 0])


def _new_directions(block: np.ndarray, held: np.ndarray) -> np.ndarray:
    """What of ``block`` the orthonormal ``held`` doesn't span, orthonormal; projected again after QR, since once loses digits."""
    least = 1e-14 * np.linalg.norm(block, axis=0).max(initial=0.0)
    q, r = np.linalg.qr(block - held @ (held.T @ block))
    q = q[:, np.abs(np.diag(r)) > least]
    return np.linalg.qr(q - held @ (held.T @ q))[0]


def components(fit: DataFrame, n: int, sums: list[int], k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, unit eigenvectors (columns) and the trace of V: at most ``k``, certified, zeros left out."""
    width = len(sums)
    k = min(k, width)
    size = min(width, k + SPARE)
    block = np.linalg.qr(np.random.default_rng(0).standard_normal((width, size)))[0]
    basis = image = np.zeros((width, 0))
    for _ in range(PASSES):
        moved, trace = _product(fit, n, sums, block)
        basis, image = np.hstack([basis, block]), np.hstack([image, moved])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, moved = basis @ turn, image @ turn
        left = moved - vectors * values
        kept = values[:k] > ZERO * max(values[0], 0.0)
        if np.linalg.norm(left[:, :k], axis=0).max() <= RESIDUAL * values[0] or basis.shape[1] == width:
            return values[:k][kept], vectors[:, :k][:, kept], trace
        block = _new_directions(left[:, :size], basis)
        if basis.shape[1] + block.shape[1] > WIDEST * size:
            basis, image = vectors[:, : 2 * size], moved[:, : 2 * size]
            block = _new_directions(left[:, :size], basis)
        if not block.shape[1]:
            return values[:k][kept], vectors[:, :k][:, kept], trace
    raise ArithmeticError(f"components not certified after {PASSES} passes over the table")


def identity_error(fit: DataFrame, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> float:
    """Largest entry, without sign, of the covariance of the whitened vectors minus the identity: one more pass."""
    turn = vectors / np.sqrt(values)

    def share(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums) @ turn
        return np.vstack([w.T @ w, w.sum(0)])

    got = _added(fit, "double", len(values), share) / n
    return float(np.abs(got[:-1] - np.outer(got[-1], got[-1]) - np.eye(len(values))).max())


def whiten(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 16) -> DataFrame:
    """A row for each vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    source = vectors.select(F.col(key).alias("key"), whole_numbers(F.col(vector)).alias("x")).where(F.size("x") > 0)
    fit = cut(source.select("x").distinct(), "fit")
    widths = [row[0] for row in fit.select(F.size("x")).distinct().collect()]
    own = vectors.schema[key].dataType
    found = [_whitened(source.where(F.size("x") == w), cut(fit.where(F.size("x") == w), "fit") if len(widths) > 1 else fit, key, k) for w in sorted(widths)]
    empty = vectors.sparkSession.createDataFrame([], f"`{key}` {own.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for part in found:
        empty = empty.unionByName(part)
    return empty if len(found) != 1 else found[0]


def _whitened(source: DataFrame, fit: DataFrame, key: str, k: int) -> DataFrame:
    n, sums = sums_of(fit)
    values, axes, trace = components(fit, n, sums, k)
    error = identity_error(fit, n, sums, values, axes) if len(values) else 0.0
    turn = axes / np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                apart = _apart(_rows(part), n, sums)
                exact = apart if int(np.abs(apart).max(initial=0)) ** 2 * len(sums) < 2**62 else apart.astype(object)
                squares = [int(d) if d < 2**63 else None for d in (exact * exact).sum(1)]
                y = (apart / n).astype(np.float64) @ turn
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(squares, pa.int64()), pa.array(list(y), pa.list_(pa.float64()))], ["key", "deviation", "y"])

    shares = F.array(*[F.lit(float(v / trace)) for v in values]) if len(values) else F.array().cast("array<double>")
    rows = source.mapInArrow(project, f"key {source.schema['key'].dataType.simpleString()}, deviation long, y array<double>")
    each = rows.select("key", "deviation", F.posexplode("y").alias("at", "whitened"))
    return each.select(F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
