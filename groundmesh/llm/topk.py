"""Exact top-k by inner product: columnar branch-and-bound over blocks of dimensions.

Vectors are packed into chunks in vertical layout (one row of a matrix per dimension). Queries are packed likewise and
meet the chunks block by block: partial products grow one block of dimensions at a time, and after each block a
candidate stays only while partial + |rest of query| * |rest of candidate| can still reach the query's k-th best score.
Survivors are compacted: whole columns while many are left, single (query, candidate) pairs when few are. Bounds are in float64
and rounded upwards; the score of a survivor is added up in whole numbers, so it is exact below 2**63. A score beyond that, or a
scaled component beyond 2**53, raises an error.

Query blocks are broadcast only while they measure at most ``BROADCAST_BYTES``; beyond, they are dealt into groups of
that size, each in several copies, and a chunk is sent to one copy of each group.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part; vectors of different
dimension are not compared; a repeated row is a candidate of its own, and a repeated query row is answered again; ties
go to the smaller id; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmesh.llm.common import materialize, shuffle_partitions

CHUNK_VECTORS = 2048
QUERY_BLOCK = 256
DIMENSION_BLOCK = 16
STEP_VECTORS = 512
STEP_PAIRS = 16_384
NONE = np.iinfo(np.int64).min
PAIRS_BELOW = 0.15
BROADCAST_BYTES = 64 << 20
PACKED = "dim int, number long, ids binary, data binary"
HITS = "query_number long, query_id long, vec_id long, score long"


def pack_vertical(vectors: DataFrame, scale: float, rows: int) -> DataFrame:
    """(id, vector) -> blobs of at most ``rows`` vectors: floor(scale * x) as int64, one matrix row per dimension."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def blob(dim: int) -> pa.RecordBatch:
            ids = np.concatenate([x for x, _ in held[dim]])
            data = np.ascontiguousarray(np.concatenate([x for _, x in held[dim]]).T)
            held[dim], count[dim] = [], 0
            return pa.RecordBatch.from_pydict({"dim": [dim], "number": [len(ids)], "ids": [ids.tobytes()], "data": [data.tobytes()]}, schema=schema)

        for batch in batches:
            column = batch[1]
            known = batch[0].is_valid().to_numpy(zero_copy_only=False)
            ids, sizes = batch[0].fill_null(0).to_numpy(), np.diff(column.offsets.to_numpy())
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            begin = column.offsets.to_numpy()[:-1]
            ok = column.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0) & (bad[begin + sizes] == bad[begin]) & known
            for dim in np.unique(sizes[ok]).tolist():
                at = np.flatnonzero(ok & (sizes == dim))
                for part in np.array_split(at, -(-len(at) // rows)):
                    values = np.floor(scale * flat[begin[part][:, None] + np.arange(dim)])
                    if np.abs(values).max() > 1 << 53:
                        raise OverflowError("a scaled component is beyond 2**53")
                    held.setdefault(dim, []).append((ids[part], values.astype(np.int64)))
                    count[dim] = count.get(dim, 0) + len(part)
                    if count[dim] >= rows:
                        yield blob(dim)
        for dim in held:
            if held[dim]:
                yield blob(dim)

    schema = pa.schema([("dim", pa.int32()), ("number", pa.int64()), ("ids", pa.binary()), ("data", pa.binary())])
    return vectors.mapInArrow(pack, PACKED)


class BranchAndBound:
    """The best k of one block of queries over all chunks that a task sees."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, k: int, block: int) -> None:
        self.ids, self.whole, self.q, self.k = ids, data, data.astype(np.float64), k
        self.blocks = [slice(i, i + block) for i in range(0, len(data), block)]
        self.rest = self.remaining(self.q)
        self.score = np.full((len(ids), k), NONE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def remaining(self, m: np.ndarray) -> np.ndarray:
        """Norm of the dimensions after each block, a little too large."""
        squares = [np.square(m[b]).sum(axis=0) for b in self.blocks]
        after = np.cumsum([np.zeros(m.shape[1]), *squares[:0:-1]], axis=0)[::-1]
        return np.sqrt(after) * (1 + 1e-9)

    def scan(self, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(ids), STEP_VECTORS):
            self.step(ids[at : at + STEP_VECTORS], x[:, at : at + STEP_VECTORS])

    def exact(self, qi: np.ndarray, whole: np.ndarray, xi: np.ndarray) -> np.ndarray:
        """Whole-number products of the pairs, STEP_PAIRS at a time."""
        out = np.empty(len(qi), dtype=np.int64)
        for at in range(0, len(qi), STEP_PAIRS):
            part = slice(at, at + STEP_PAIRS)
            out[part] = (self.whole[:, qi[part]] * whole[:, xi[part]]).sum(axis=0)
        return out

    def step(self, ids: np.ndarray, whole: np.ndarray) -> None:
        x = whole.astype(np.float64)
        least, rest = self.score[:, -1].astype(np.float64), self.remaining(x)
        error = 1e-6 + 1e-12 * np.sqrt(np.square(self.q).sum(axis=0).max(initial=0) * np.square(x).sum(axis=0).max(initial=0))
        columns = np.arange(x.shape[1])
        sums = np.zeros((self.q.shape[1], len(columns)))
        pairs = None
        for n, block in enumerate(self.blocks):
            if pairs is None:
                sums += self.q[block].T @ x[block][:, columns]
                bound = sums + self.rest[n][:, None] * rest[n][columns] + error
                stay = bound >= least[:, None]
                if stay.mean() <= PAIRS_BELOW or n == len(self.blocks) - 1:
                    qi, ci = np.nonzero(stay)
                    pairs = [qi, columns[ci], sums[qi, ci]]
                elif not (some := stay.any(axis=0)).all():
                    columns, sums = columns[some], sums[:, some]
            else:
                qi, xi, total = pairs
                total = total + (self.q[block][:, qi] * x[block][:, xi]).sum(axis=0)
                stay = total + self.rest[n][qi] * rest[n][xi] + error >= least[qi]
                pairs = [qi[stay], xi[stay], total[stay]]
        qi, xi, total = pairs
        if len(total) and np.abs(total).max() >= 2.0**63:
            raise OverflowError("a score is beyond 2**63")
        total = self.exact(qi, whole, xi)
        vec = ids[xi]
        keep = (vec != self.ids[qi]) & ((total > self.score[qi, -1]) | (total == self.score[qi, -1]) & (vec < self.found[qi, -1]))
        if keep.any():
            self.merge(qi[keep], vec[keep], total[keep])

    def merge(self, qi: np.ndarray, vec: np.ndarray, total: np.ndarray) -> None:
        touched, k = np.unique(qi), self.k
        qi = np.concatenate([qi, np.repeat(touched, k)])
        vec = np.concatenate([vec, self.found[touched].ravel()])
        total = np.concatenate([total, self.score[touched].ravel()])
        order = np.lexsort((vec, ~total, qi))
        qi, vec, total = qi[order], vec[order], total[order]
        starts = np.searchsorted(qi, touched)
        best = starts[:, None] + np.arange(k)
        self.score[touched], self.found[touched] = total[best], vec[best]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        qi, at = np.nonzero(self.score != NONE)
        return qi, self.found[qi, at], self.score[qi, at]


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", dimension_block: int = DIMENSION_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query row, its own id left out."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    chunks = pack_vertical(rows.select("id", "v"), scale, CHUNK_VECTORS)
    queries = pack_vertical(rows.where("q").select("id", "v"), scale, QUERY_BLOCK)
    queries = materialize(queries.withColumn("block", F.monotonically_increasing_id()), "queries")
    held = queries.agg(F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("b")).first()["b"]
    groups = max(1, -(-held // BROADCAST_BYTES))
    copies = 1 if groups == 1 else -(-shuffle_partitions(vectors.sparkSession) // groups)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    sides = queries.select("dim", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("grp"), "block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), every(copies).alias("copy"))
    if groups == 1:
        sides = F.broadcast(sides)
    dealt = chunks.withColumn("copy", F.pmod(F.xxhash64("ids"), F.lit(copies))).withColumn("grp", every(groups))
    met = dealt.join(sides, ["dim", "grp", "copy"]).select("dim", "ids", "data", "block", "q_ids", "q_data")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, BranchAndBound] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                dim, ids, data, block, q_ids, q_data = (c[row] for c in batch.columns)
                dim, block = dim.as_py(), block.as_py()
                if block not in state:
                    state[block] = BranchAndBound(np.frombuffer(q_ids.as_buffer(), np.int64), np.frombuffer(q_data.as_buffer(), np.int64).reshape(dim, -1), k, dimension_block)
                state[block].scan(np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(data.as_buffer(), np.int64).reshape(dim, -1))
        for block, best in state.items():
            qi, vec, score = best.hits()
            yield pa.RecordBatch.from_arrays([pa.array(block * QUERY_BLOCK * 2 + qi), pa.array(best.ids[qi]), pa.array(vec), pa.array(score)], names=["query_number", "query_id", "vec_id", "score"])

    ranked = W.partitionBy("query_id", "query_number").orderBy(F.desc("score"), "vec_id")
    best = met.mapInArrow(search, HITS).withColumn("rank", F.row_number().over(ranked))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
