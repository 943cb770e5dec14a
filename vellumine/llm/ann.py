"""Largest inner products by score-aware quantisation, four-bit tables and exact reranking.

Vectors are cut into subspaces of two dimensions with sixteen centres each, four bits a
subspace. Codebooks and codes minimise the anisotropic loss: the part of the residual
that is parallel to the vector, which distorts large inner products most, weighs
``eta`` = (d - 1) t^2 / (1 - t^2) times the orthogonal part. Codes are found by
coordinate descent, since the parallel part ties the subspaces together, and codebooks
by weighted least squares on a bounded sample; every row is then encoded.

A query becomes a table of its products with all centres; two four-bit look-ups are
fused into one of a byte. Queries go to the rows in blocks: a task scans its codes batch
by batch, reranks the best ``RERANK`` distinct vectors of each by exact products in double
precision, keeps the best ``k`` of all its batches and sends these; a window merges them.

Cases: vectors that are null, empty or zero, or hold a null or a non-finite component,
and rows without vec_id take no part. Vectors of different lengths have no inner product:
each length is searched by itself. Equal vectors are scanned once and expanded, smaller
vec_id first. A row that repeats an id is a candidate of its own; a query of a repeated id is
asked once, with the vector that is least by its components. A query never finds its own
id. With fewer candidates than ``k`` all are returned. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.shared import cut

#: Rows that the codebooks are fitted on, those with the smallest hash of vec_id.
FIT_ROWS = 8192
SUB, CENTRES = 2, 16
#: Inner products from this share of the norms count as large.
LARGE = 0.2
ROUNDS, SWEEPS = 4, 2
#: Distinct vectors that each task reranks for a query at first; from these it learns how far
#: products by table stray (one standard deviation), and then reranks every vector whose
#: product by table is within ``STRAY`` deviations of the k-th best exact one. So a crowd
#: of vectors that the codes can't tell apart is reranked whole.
RERANK, STRAY = 100, 2.5
#: Queries that go to the rows at once, and that are scanned together.
BLOCK, SCAN = 65_536, 128


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    v = vector.cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def _cut(x: np.ndarray) -> np.ndarray:
    """(n, subspaces, SUB), with zeros where the length is odd."""
    pad = -x.shape[1] % (2 * SUB)  # an even number of subspaces, for bytes
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SUB)


def encode(x: np.ndarray, books: np.ndarray, eta: float) -> np.ndarray:
    """Codes (n, subspaces) that minimise |r|^2 + (eta - 1) (r . x)^2 / |x|^2."""
    parts = _cut(x)
    norm = np.maximum((x**2).sum(axis=1), 1e-30)
    codes = np.empty(parts.shape[:2], np.uint8)
    along = np.zeros(len(x))
    for j in range(parts.shape[1]):
        codes[:, j] = ((parts[:, j, None] - books[j]) ** 2).sum(axis=2).argmin(axis=1)
        along += ((parts[:, j] - books[j][codes[:, j]]) * parts[:, j]).sum(axis=1)
    for _ in range(SWEEPS):
        for j in range(parts.shape[1]):
            left = parts[:, j, None] - books[j]
            dots = (left * parts[:, j, None]).sum(axis=2)
            rest = along - np.take_along_axis(dots, codes[:, j, None].astype(int), 1)[:, 0]
            loss = (left**2).sum(axis=2) + (eta - 1) * (rest[:, None] + dots) ** 2 / norm[:, None]
            codes[:, j] = loss.argmin(axis=1)
            along = rest + np.take_along_axis(dots, codes[:, j, None].astype(int), 1)[:, 0]
    return codes


def fit(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Codebooks (subspaces, CENTRES, SUB) and eta."""
    d = x.shape[1]
    eta = max(1.0, (d - 1) * LARGE**2 / (1 - LARGE**2))
    parts, rng = _cut(x), np.random.default_rng(seed)
    books = np.stack([parts[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), j] for j in range(parts.shape[1])])
    for _ in range(ROUNDS):  # plain k-means to start from
        for j in range(len(books)):
            near = ((parts[:, j, None] - books[j]) ** 2).sum(axis=2).argmin(axis=1)
            n = np.bincount(near, minlength=CENTRES)
            for s in range(SUB):
                total = np.bincount(near, parts[:, j, s], CENTRES)
                books[j, :, s] = np.where(n > 0, total / np.maximum(n, 1), books[j, :, s])
    norm = np.maximum((x**2).sum(axis=1), 1e-30)
    m, size = len(books), len(books) * CENTRES * SUB
    for _ in range(ROUNDS):
        codes = encode(x, books, eta)
        slot = (np.arange(m) * CENTRES + codes)[:, :, None] * SUB + np.arange(SUB)
        rows = np.zeros((len(x), size), np.float32)
        np.put_along_axis(rows, slot.reshape(len(x), -1), parts.reshape(len(x), -1).astype(np.float32), 1)
        weight = ((eta - 1) / norm).astype(np.float32)
        normal = (rows * weight[:, None]).T.astype(np.float64) @ rows
        normal[np.diag_indices(size)] += np.bincount(slot.ravel(), minlength=size) + 1e-6
        target = np.bincount(slot.ravel(), parts.ravel(), size) + (eta - 1) * rows.sum(axis=0, dtype=np.float64)
        target += 1e-6 * books.ravel()
        books = np.linalg.solve(normal, target).reshape(books.shape)
    return books, eta


def tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(bytes, 256, queries): products with the centres of two subspaces, fused."""
    single = np.einsum("qms,mcs->mcq", _cut(queries), books).astype(np.float32)
    low, high = single[0::2], single[1::2]
    return (high[:, :, None] + low[:, None]).reshape(len(low), CENTRES * CENTRES, -1)


def packed(codes: np.ndarray) -> np.ndarray:
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def search_part(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, books: np.ndarray, k: int, rerank: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query's row, vec_id, score) of the best ``k`` of these rows for each query, which is told from the others by its row, not its id."""
    order = np.argsort(ids, kind="stable")
    rows, ids, x, codes = rows[order], ids[order], x[order], codes[order]
    _, first, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_index=True, return_inverse=True)
    by_group = np.argsort(group, kind="stable")  # within a group by id
    starts = np.searchsorted(group[by_group], np.arange(len(first) + 1))
    scanned, exact = codes[first].astype(np.intp), x[first].astype(np.float64)
    for at in range(0, len(queries), SCAN):
        q = queries[at : at + SCAN]
        table = tables(q, books)
        found = table[0][scanned[:, 0]]
        for j in range(1, len(table)):
            found += table[j][scanned[:, j]]
        r = min(rerank, len(first))
        best = np.argpartition(-found, r - 1, axis=0)[:r] if r < len(first) else np.repeat(np.arange(r)[:, None], len(q), axis=1)
        for i in range(len(q)):
            chosen = best[:, i]
            score = (exact[chosen] * q[i]).sum(axis=1)
            if r < len(first):
                reach = np.partition(score, max(0, len(score) - k - 1))[max(0, len(score) - k - 1)] - STRAY * np.std(score - found[chosen, i])
                chosen = np.flatnonzero(found[:, i] >= min(reach, found[chosen, i].min()))
                score = (exact[chosen] * q[i]).sum(axis=1)
            top = np.lexsort((ids[first[chosen]], -score))[: k + 1]
            members, scores = [], []
            for g, s in zip(chosen[top], score[top], strict=True):
                own = by_group[starts[g] : min(starts[g] + k + 1, starts[g + 1])]
                members.append(own)
                scores.append(np.full(len(own), s))
            member, score = np.concatenate(members), np.concatenate(scores)
            keep = rows[member] != query_rows[at + i]
            member, score = ids[member[keep]], score[keep]
            top = np.lexsort((member, -score))[:k]
            yield np.full(len(top), query_rows[at + i]), member[top], score[top]


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, key: str = "vec_id", vector: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` for which ``is_query`` holds.

    ``is_query`` is an expression over the column ``vec_id``.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & usable(F.col("x")))
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for row in rows.select(F.size("x").alias("n")).distinct().orderBy("n").collect():
        found = found.unionByName(_of_length(rows.where(F.size("x") == row["n"]), is_query, k, rerank))
    return found


def _of_length(rows: DataFrame, is_query: Column, k: int, rerank: int) -> DataFrame:
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(FIT_ROWS).select("x").toPandas()
    books, eta = fit(np.stack(sample["x"].to_numpy()))
    model = spark.sparkContext.broadcast({"books": books, "eta": eta})

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes = packed(encode(np.stack(b["x"].to_numpy()), model.value["books"], model.value["eta"])) if len(b) else []
            yield pd.DataFrame({"vec_id": b["vec_id"], "x": b["x"], "codes": [c.tobytes() for c in codes]})

    coded = rows.mapInPandas(index, "vec_id long, x array<double>, codes binary")
    indexed = cut(coded.withColumn("row", F.monotonically_increasing_id()), "codes")
    asked = indexed.where(is_query).select("row", "vec_id", "x")
    blocks = max(1, -(-asked.count() // BLOCK))
    merged = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).toPandas()
        if not len(part):
            continue
        part = part.sort_values("row")
        shared = spark.sparkContext.broadcast((part["row"].to_numpy(np.int64), part["vec_id"].to_numpy(np.int64), np.stack(part["x"].to_numpy())))
        found = indexed.mapInPandas(_scan(shared, model, k, rerank), "query_row long, query_id long, vec_id long, score double")
        by = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:  # the driver holds one block of queries at a time
            found = cut(found, "nearest")
            shared.destroy()
        merged = found if merged is None else merged.unionByName(found)
    return merged if merged is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


class Best:
    """The ``k`` best rows of each query so far: largest score, then smallest vec_id."""

    def __init__(self, k: int):
        self.k = k
        self.query, self.vec, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        query, vec, score = (np.concatenate(x) for x in ((self.query, query), (self.vec, vec), (self.score, score)))
        order = np.lexsort((vec, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = order[place < self.k]
        self.query, self.vec, self.score = query[place < self.k], vec[keep], score[keep]


def _scan(shared: Any, model: Any, k: int, rerank: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(k)
        for b in batches:
            if not len(b):
                continue
            codes = np.frombuffer(b"".join(b["codes"]), np.uint8).reshape(len(b), -1)
            rows, _, queries = shared.value
            got = list(search_part(b["row"].to_numpy(np.int64), b["vec_id"].to_numpy(np.int64), np.stack(b["x"].to_numpy()), codes, rows, queries, model.value["books"], k, rerank))
            best.add(*map(np.concatenate, zip(*got, strict=True)))
        rows, ids, _ = shared.value
        for a in range(0, len(best.query), 100_000):
            query = best.query[a : a + 100_000]
            yield pd.DataFrame({"query_row": query, "query_id": ids[np.searchsorted(rows, query)], "vec_id": best.vec[a : a + 100_000], "score": best.score[a : a + 100_000]})

    return scan
