"""Cosine top-k, exact, from a stored index of cells: what cannot win by the triangle inequality is not read.

Centres come of a bounded sample; every vector goes to its nearest centre's cell (a zero vector to a cell of its own). A cell's vectors are ordered by their distance
to the centre and cut into blocks; a block is one row: cell, the least and greatest distance, ids and unit vectors. A vector x of a block with
distances low..high is at least max(d - high, low - d, 0) from a query at distance d from the centre, which bounds its cosine.

A search scans distances only, without vectors, and takes for each query the blocks with the highest bounds that hold k vectors; their k-th score is the
threshold. Blocks whose bound reaches it are read then, each query in those alone. Scores and ties are those of ``vectors.vector_topk``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmesh.sources.store import checkpointed, new_folder

BLOCK = 256
#: Vectors that centres are fitted on, rounds of fitting, and the most cells of an index.
SAMPLE, ROUNDS, MAX_CELLS = 20_000, 8, 4096
#: Bytes of query vectors, and query distances to centres, of one pass over the index.
PASS_BYTES, PASS_DISTANCES = 32 << 20, 4_000_000
BROADCAST_PAIRS = 1_000_000
BLOCKS = "dim int, cell int, block long, low double, high double, n int, first_id string, ids array<string>, data binary"
BOUNDS = "q int, block long, n int, bound double"
FOUND = "q int, id string, score double"
SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def vectors_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: rows of the batch, and their unit vectors."""
    begin, sizes = column.offsets.to_numpy()[:-1], np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
    for dim in np.unique(sizes[usable]).tolist():
        at = np.flatnonzero(usable & (sizes == dim))
        yield dim, at, unit(flat[begin[at][:, None] + np.arange(dim)])


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of rows to centres."""
    squared = np.square(x).sum(axis=1)[:, None] + np.square(centres).sum(axis=1) - 2 * x @ centres.T
    return np.sqrt(np.maximum(squared, 0.0))


def fit_centres(x: np.ndarray, cells: int) -> np.ndarray:
    """Lloyd's rounds from evenly spread rows of the sample; the last centre is 0."""
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)] if len(x) else x
    for _ in range(ROUNDS if len(x) else 0):
        nearest = distances(x, centres).argmin(axis=1)
        count = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return np.vstack([centres, np.zeros((1, x.shape[1]))])


@dataclass(frozen=True)
class VectorIndex:
    """Written blocks, and the centres of the cells for each length of vectors."""

    blocks: DataFrame
    centres: dict[int, np.ndarray]

    @staticmethod
    def stored(spark: SparkSession, folder: str) -> VectorIndex:
        rows = spark.read.parquet(f"{folder}/centres").orderBy("dim", "cell").collect()  # at most MAX_CELLS a length
        by_dim: dict[int, list] = {}
        for r in rows:
            by_dim.setdefault(r["dim"], []).append(r["centre"])
        return VectorIndex(spark.read.schema(BLOCKS).parquet(f"{folder}/blocks"), {d: np.array(c) for d, c in by_dim.items()})

    @staticmethod
    def write(corpus: DataFrame, folder: str | None = None, id_col: str = "id", vector_col: str = "vector", cells: int | None = None, block: int = BLOCK) -> VectorIndex:
        """Index corpus; null ids and vectors go. ``cells``: by default the root of the number of vectors."""
        spark, folder = corpus.sparkSession, folder or new_folder(corpus.sparkSession, "vectors")
        rows = corpus.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
        counts = {r["dim"]: r["n"] for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
        centres = {}
        for dim, n in counts.items():
            sample = rows.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
            x = np.concatenate([m for b in sample.to_batches() for _, _, m in vectors_of(b["v"])])
            centres[dim] = fit_centres(x[np.square(x).sum(axis=1) > 0], min(MAX_CELLS, cells or max(1, round(n**0.5))))
        listed = [(d, i, c.tolist()) for d, m in centres.items() for i, c in enumerate(m)]
        spark.createDataFrame(listed, "dim int, cell int, centre array<double>").write.parquet(f"{folder}/centres")
        shared = spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, at, x in vectors_of(batch["v"]):
                    d = distances(x, shared.value[dim])
                    zero = ~x.any(axis=1)
                    d[:, -1] = np.where(zero, 0.0, np.inf)
                    cell = d.argmin(axis=1)
                    vectors = pa.array([row.tobytes() for row in x], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(at)), cell]), batch["id"].take(pa.array(at)), vectors], names=["dim", "cell", "r", "id", "x"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            held: pa.Table | None = None

            def rows_of(table: pa.Table) -> pa.RecordBatch:
                r, ids = table["r"].to_numpy(), table["id"].to_pylist()
                row = table["dim"][0].as_py(), table["cell"][0].as_py(), number, r[0], r[-1], len(ids), min(ids), ids, b"".join(table["x"].to_pylist())
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

            for batch in batches:
                held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
                dims, cell = held["dim"].to_numpy(), held["cell"].to_numpy()
                cuts = np.flatnonzero((dims[1:] != dims[:-1]) | (cell[1:] != cell[:-1])) + 1
                begin = 0
                for end in [*cuts.tolist(), held.num_rows]:
                    while end - begin >= block or end < held.num_rows and end > begin:
                        size = min(block, end - begin)
                        yield rows_of(held.slice(begin, size))
                        begin, number = begin + size, number + 1
                held = held.slice(begin)
            if held is not None and held.num_rows:
                yield rows_of(held)

        schema = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("block", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), ("first_id", pa.string()), ("ids", pa.list_(pa.string())), ("data", pa.binary())])
        assigned = checkpointed(rows.mapInArrow(assign, "dim int, cell int, r double, id string, x binary"))
        order = ["dim", "cell", "r", "id"]
        ranged = assigned.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
        ranged.mapInArrow(pack, BLOCKS).write.parquet(f"{folder}/blocks")
        return VectorIndex.stored(spark, folder)


@dataclass(frozen=True)
class Asked:
    """Query vectors of one length, their distances to the centres, and how many hits each wants."""

    x: np.ndarray
    d: np.ndarray
    k: int

    def bounds(self, cell: int, low: float, high: float) -> np.ndarray:
        """The most that a vector of the block can score, for every query."""
        d = self.d[:, cell]
        if cell == self.d.shape[1] - 1:
            return np.zeros(len(d))  # zero vectors
        gap = np.maximum(np.maximum(d - high, low - d) - SLACK, 0.0)
        some = self.x.any(axis=1)
        return np.round(np.where(some, np.maximum(1 - np.square(gap) / 2, 0.0), 0.0) + SLACK, 9)


def scan(blocks: DataFrame, dim: int, asked: Asked, least: np.ndarray | None) -> DataFrame:
    """BOUNDS: blocks that reach ``least``, or without it the best blocks of each query that hold k vectors, of each task."""
    shared = blocks.sparkSession.sparkContext.broadcast((asked, least))

    def rows(q: np.ndarray, block: np.ndarray, n: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(block), pa.array(n.astype(np.int32)), pa.array(bound)], names=["q", "block", "n", "bound"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, least = shared.value
        count = len(asked.x)
        for batch in batches:
            cell, low, high, block, n = (batch[c].to_numpy() for c in ("cell", "low", "high", "block", "n"))
            if not len(cell):
                continue
            table = np.array([asked.bounds(*b) for b in zip(cell.tolist(), low.tolist(), high.tolist(), strict=True)])
            if least is not None:
                at, q = np.nonzero(table >= least)
                yield rows(q, block[at], n[at], table[at, q])
                continue
            order = np.argsort(-table, axis=0, kind="stable")
            earlier = np.cumsum(n[order], axis=0) - n[order]
            place, q = np.nonzero(earlier < asked.k)
            at = order[place, q]
            yield rows(q, block[at], n[at], table[at, q])

    return blocks.where(F.col("dim") == dim).select("cell", "low", "high", "block", "n").mapInArrow(run, BOUNDS)


def read(blocks: DataFrame, wanted: DataFrame, asked: Asked) -> DataFrame:
    """FOUND: the k best of each wanted (q, block)."""
    shared = blocks.sparkSession.sparkContext.broadcast(asked)
    lists = checkpointed(wanted.groupBy("block").agg(F.collect_list("q").alias("asked")))  # no more than the queries of a pass
    size = lists.agg(F.coalesce(F.sum(F.size("asked")), F.lit(0)).alias("n")).first()["n"]
    met = blocks.select("block", "ids", "data").join(F.broadcast(lists) if size <= BROADCAST_PAIRS else lists, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            for ids, data, wanted in zip(batch["ids"], batch["data"], batch["asked"], strict=True):
                q = wanted.values.to_numpy()
                m = np.frombuffer(data.as_buffer()).reshape(-1, asked.x.shape[1])
                scores = np.maximum(0.0, np.round(asked.x[q] @ m.T, 9))
                names = np.array(ids.as_py(), dtype=str)
                row = np.repeat(np.arange(len(q)), len(names))
                name = np.tile(names, len(q))
                order = np.lexsort((name, -scores.ravel(), row))
                kept = order[np.arange(len(order)) % len(names) < asked.k]
                yield pa.RecordBatch.from_arrays([pa.array(q[row[kept]].astype(np.int32)), pa.array(name[kept].tolist(), pa.string()), pa.array(scores.ravel()[kept])], names=["q", "id", "score"])

    return met.select("ids", "data", "asked").mapInArrow(run, FOUND)


def search_pass(index: VectorIndex, dim: int, x: np.ndarray, k: int) -> tuple[DataFrame, DataFrame]:
    """(FOUND rows, (q, block, n) of every block read) of the queries of one pass."""
    asked = Asked(x, distances(x, index.centres[dim]), k)
    best = W.partitionBy("q").orderBy(F.desc("bound"), "block")
    near = scan(index.blocks, dim, asked, None).withColumn("_earlier", F.coalesce(F.sum("n").over(best.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    near = checkpointed(near.where(F.col("_earlier") < k).select("q", "block", "n"))
    first = checkpointed(read(index.blocks, near, asked))
    nth = first.withColumn("_n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("_n") == k)
    least = np.full(len(x), -1.0)
    for r in nth.select("q", "score").collect():  # a row for each query of the pass
        least[r["q"]] = r["score"]
    rest = checkpointed(scan(index.blocks, dim, asked, least).join(near, ["q", "block"], "left_anti").select("q", "block", "n"))
    return first.unionByName(read(index.blocks, rest, asked)), near.unionByName(rest)


def vector_search(queries: DataFrame, index: VectorIndex, k: int, query_id: str = "query_id", query_vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(query_id, id, score, rank of the k nearest; query_id, vectors read and blocks read) of every query with a vector."""
    spark, kind = queries.sparkSession, queries.schema[query_id].dataType
    asked = checkpointed(queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("v")).where("size(v) > 0"))
    hits = looked = None

    def search(dim: int, names: list, vectors: list) -> None:
        nonlocal hits, looked
        named = spark.createDataFrame([(n, q) for n, q in enumerate(names)], f"q int, query_id {kind.simpleString()}")
        found, blocks = search_pass(index, dim, unit(np.array(vectors, dtype=np.float64).reshape(len(names), dim)), k)
        blocks = blocks.groupBy("q").agg(F.sum("n").alias("vectors_read"), F.count(F.lit(1)).alias("blocks_read"))
        found, blocks = (x.join(F.broadcast(named), "q").drop("q") for x in (found, blocks))  # the queries of a pass
        hits, looked = (found, blocks) if hits is None else (hits.unionByName(found), looked.unionByName(blocks))

    for dim, centres in index.centres.items():
        most = max(1, min(PASS_BYTES // (8 * dim), PASS_DISTANCES // len(centres)))
        names, vectors = [], []
        for row in asked.where(F.size("v") == dim).toLocalIterator():
            names.append(row["query_id"])
            vectors.append(row["v"])
            if len(names) >= most:
                search(dim, names, vectors)
                names, vectors = [], []
        if names:
            search(dim, names, vectors)
    if hits is None:
        empty = asked.select("query_id").limit(0)
        return empty.select("query_id", F.lit("").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")), empty.select("query_id", F.lit(0).cast("long").alias("vectors_read"), F.lit(0).cast("long").alias("blocks_read"))
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "id", "score", "rank"), looked
