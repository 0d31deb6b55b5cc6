"""Whitening of embeddings by mixed-precision eigenvectors of their distributed covariance.

Components are scaled to whole numbers; their sums are exact. The covariance is added up by tasks from vectors
centred by the rounded mean, in whole numbers as long as they stay below 2**53, and brought to the driver as one matrix of
dimension x dimension. Its eigenvectors are found in float32 and corrected by Ogita-Aishima iterations, matrix products in float64 and
then in extended precision: with R = I - X'X and S = X'VX the correction of X is X E, where E holds
(s_ij + l_j r_ij) / (l_j - l_i), or r_ij / 2 where two eigenvalues are too close to be told apart. The vectors of such a cluster are turned
by the eigenvectors of their own small matrix, X_k'(V - m I)X_k, which tells the eigenvalues of a cluster apart, and corrected again.

Defined cases: vectors that are null, empty or hold null or non-finite entries take no part; where lengths differ, vectors of the commonest
length do (the smallest of equally common ones); components without variance are left out; a null id is kept; repeated rows count and are answered each; an
empty table gives an empty result; extra columns are not read. A scaled entry of 2**52 or a deviation of 2**63 is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
ROWS = 4096
SUMS = "dim int, number long, i int, j int, total double, whole long"
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Corrections at most in each precision; they stop as soon as they no longer shrink.
ITERATIONS = 8
#: Couplings up to this share of the gap of two eigenvalues are left to the corrections.
SMALL = 0.01


def whole_vectors(column: pa.Array, dim: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length (or one): the rows with a usable vector of it, and floor(SCALE * x) + SHIFT as int64."""
    sizes, begin = np.diff(column.offsets.to_numpy()), column.offsets.to_numpy()[:-1]
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
    ok &= bad[begin + np.where(ok, sizes, 0)] == bad[begin]
    for size in np.unique(sizes[ok]).tolist() if dim is None else [dim]:
        rows = np.flatnonzero(ok & (sizes == size))
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            values = np.floor(SCALE * flat[begin[part][:, None] + np.arange(size)])
            if np.abs(values).max() >= 1 << 52:
                raise OverflowError("a scaled entry is beyond 2**52")
            yield size, part, values.astype(np.int64) + SHIFT


def vector_sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """The commonest length, the number of its vectors, and their exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, x in whole_vectors(batch["v"]):
                low = x & 0xFFFF_FFFF  # sums in two halves stay whole in a long
                for part, half in ((0, low), (1, x >> 32)):
                    sums = half.sum(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.full(dim, len(rows))), pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, part, np.int32)), pa.array(np.zeros(dim)), pa.array(sums)], schema=schema)

    schema = pa.schema([("dim", pa.int32()), ("number", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64()), ("whole", pa.int64())])
    summed = vectors.mapInArrow(run, SUMS).groupBy("dim", "i", "j").agg(F.sum("number").alias("number"), F.sum("whole").alias("whole"))
    common = summed.where("i = 0 AND j = 0").orderBy(F.desc("number"), "dim").select("dim", "number").first()
    if common is None:
        return 0, 0, []
    sums = [0] * common["dim"]
    for r in summed.where(F.col("dim") == common["dim"]).select("i", "j", "whole").collect():  # two rows a dimension
        sums[r["i"]] += r["whole"] << (32 * r["j"])
    return common["dim"], common["number"], sums


def covariance(vectors: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance over all vectors, in extended precision: products of vectors centred by the rounded mean, then the rest of the mean."""
    middle, rest = centre(n, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            for _, _, x in whole_vectors(batch["v"], dim):
                d = (x - middle).astype(np.float64)
                total += d.T @ d
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "total"])

    rows = vectors.mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()  # dimension x dimension
    v = np.zeros((dim, dim), dtype=np.longdouble)
    for r in rows:
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = r["total"]
    return v / n - np.outer(rest, rest)


def centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The rounded mean as int64, and what is left of the mean."""
    middle = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(middle, dtype=np.int64), np.array([np.longdouble(s - n * m) / n for s, m in zip(sums, middle, strict=True)], dtype=np.longdouble)


def corrected(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One Ogita-Aishima correction in the precision of v: better eigenvectors, their eigenvalues, and the correction E."""
    x = x.astype(v.dtype)
    r = np.eye(len(v), dtype=v.dtype) - x.T @ x
    s = x.T @ v @ x
    values = np.diag(s) / (1 - np.diag(r))
    unsure = 2 * (np.abs(s - np.diag(np.diag(s))).sum(axis=0).max() + np.abs(v).sum(axis=0).max() * np.abs(r).sum(axis=0).max())
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > unsure
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, values, e


def orthonormal(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns, orthonormal to working precision."""
    for _ in range(2):
        x = x + x @ ((np.eye(len(x), dtype=x.dtype) - x.T @ x) / 2)
    return x


def split_clusters(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Turn the vectors of each cluster of eigenvalues by the eigenvectors of their own shifted matrix.

    A cluster is where the couplings between vectors are not small beside the gaps of their eigenvalues, so that a correction would not be either.
    """
    x = orthonormal(x)
    s = x.T @ v @ x
    order = np.argsort(-np.diag(s), kind="stable")
    x, s = x[:, order], s[np.ix_(order, order)]
    values = np.diag(s)
    coupled = np.abs(s) > SMALL * np.abs(values[None, :] - values[:, None])
    np.fill_diagonal(coupled, True)
    last = np.maximum.accumulate([int(np.flatnonzero(row)[-1]) for row in coupled])
    bounds = [0, *(np.flatnonzero(last == np.arange(len(values))) + 1).tolist()]
    for a, b in zip(bounds, bounds[1:]):
        if b - a > 1:
            part = x[:, a:b]
            inner = part.T @ (v - values[a:b].mean() * np.eye(len(v), dtype=v.dtype)) @ part
            size = np.abs(inner).max()
            if size > 0:
                turn = np.linalg.eigh(((inner + inner.T) / (2 * size)).astype(np.float64))[1]
                x[:, a:b] = part @ turn[:, ::-1].astype(v.dtype)
    return x


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix in extended precision."""
    scale = np.abs(v).max()
    if not scale > 0:
        return np.zeros(len(v), dtype=v.dtype), np.eye(len(v), dtype=v.dtype)
    v = v / scale
    x = np.linalg.eigh(v.astype(np.float32))[1]
    for kind in (np.float64, np.longdouble):
        exact, x, before = v.astype(kind), x.astype(kind), np.inf
        for _ in range(ITERATIONS):
            x, _, e = corrected(exact, split_clusters(exact, x))
            size = np.abs(e).max()
            if size <= 16 * np.finfo(kind).eps or size >= before:
                break
            before = size
    x = orthonormal(x)
    values = np.einsum("ij,ij->j", x, v @ x)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


class Whitener:
    """The fitted components: what every task needs to whiten its vectors."""

    def __init__(self, n: int, sums: list[int], v: np.ndarray, components: int) -> None:
        values, vectors = eigenvectors(v)
        trace = np.trace(v)
        keep = np.flatnonzero(values[:components] > len(v) * 1e-15 * trace)
        self.n, self.dim = n, len(v)
        self.middle, rest = centre(n, sums)
        self.rest = rest.astype(np.float64)
        self.left = np.array([s - n * m for s, m in zip(sums, self.middle.tolist(), strict=True)], dtype=np.int64)
        self.matrix = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float64)
        self.explained = (values[keep] / trace).astype(np.float64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle).astype(np.float64) - self.rest) @ self.matrix

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)**2."""
        d = x - self.middle
        if (np.square(self.n * d.astype(np.float64) - self.left).sum(axis=1)).max(initial=0) >= 0.999 * 2.0**63:
            raise OverflowError("a deviation is beyond 2**63")
        return np.square(self.n * d - self.left).sum(axis=1)


def identity_error(vectors: DataFrame, fitted: Whitener) -> float:
    """Largest entry of the covariance of all whitened vectors minus the identity, without sign; measured, by sums of tasks."""
    k = len(fitted.explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for _, _, x in whole_vectors(batch["v"], fitted.dim):
                w = fitted.whiten(x)
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "total"])

    total = np.zeros((k + 1, k))
    for r in vectors.mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():  # k + 1 rows of k
        total[r["i"], r["j"]] = r["total"]
    mean = total[k] / fitted.n
    return float(np.abs(total[:k] / fitted.n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """WHITENED columns: a row for each usable vector and component, fitted on all of them."""
    vectors = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    dim, n, sums = vector_sums(vectors.select("v"))
    if not n:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    fitted = Whitener(n, sums, covariance(vectors.select("v"), dim, n, sums), components)
    error = identity_error(vectors.select("v"), fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fitted.explained)
        for batch in batches:
            for _, rows, x in whole_vectors(batch["v"], dim):
                repeat = np.repeat(rows, k)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(repeat), n)), pa.array(np.repeat(fitted.deviation(x), k)), pa.array(fitted.whiten(x).ravel()), pa.array(np.tile(fitted.explained, len(rows))), pa.array(np.full(len(repeat), error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(run, WHITENED)
