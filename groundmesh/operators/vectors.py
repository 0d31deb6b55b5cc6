"""Cosine top-k of a query table against a whole collection, in blocks.

Vectors are packed into matrices inside tasks. Query blocks are broadcast while they measure at most BROADCAST_BYTES;
beyond, they are dealt into groups of that size, each in several copies, and a block of the collection is sent to one copy of
each group. A task keeps the k best per query over all its blocks, so k rows per query and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1024
BROADCAST_BYTES = 64 << 20
PACKED = "dim int, n int, ids array<string>, data binary"


def pack(df: DataFrame, id_col: str, vector_col: str, rows: int = BLOCK) -> DataFrame:
    """(id, vector) -> unit-length float64 matrices of at most ``rows`` vectors of one dimension. Null vectors go; a zero vector stays zero."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.string())), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def blob(dim: int) -> pa.RecordBatch:
            ids, vectors = held.pop(dim)
            m = np.array(vectors, dtype=np.float64).reshape(len(ids), dim)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            return pa.RecordBatch.from_pydict({"dim": [dim], "n": [len(ids)], "ids": [ids], "data": [m.tobytes()]}, schema=schema)

        for batch in batches:
            for key, vector in zip(batch.column(0), batch.column(1), strict=True):
                if key.is_valid and vector.is_valid and len(vector):
                    dim = len(vector)
                    ids, vectors = held.setdefault(dim, ([], []))
                    ids.append(key.as_py())
                    vectors.append(vector.values.to_numpy(zero_copy_only=False))
                    if len(ids) >= rows:
                        yield blob(dim)
        for dim in list(held):
            yield blob(dim)

    return df.select(F.col(id_col).cast("string"), F.col(vector_col).cast("array<double>")).mapInArrow(run, PACKED)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "vector", corpus_id: str = "id", corpus_vector: str = "vector") -> DataFrame:
    """query_id, id, score, rank: the k nearest by cosine, score max(0, cosine); ranked on nine digits, ties to the smaller id."""
    spark = queries.sparkSession
    packed = pack(queries, query_id, query_vector, 256).withColumn("block", F.monotonically_increasing_id())
    size = packed.agg(F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("b")).first()["b"]
    groups = max(1, -(-size // BROADCAST_BYTES))
    copies = 1 if groups == 1 else -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // groups)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    side = packed.select("dim", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("grp"), "block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), every(copies).alias("copy"))
    if groups == 1:
        side = F.broadcast(side)
    blocks = pack(corpus, corpus_id, corpus_vector).withColumn("copy", F.pmod(F.xxhash64("ids"), F.lit(copies))).withColumn("grp", every(groups))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, list[str]] = {}
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, ids, data, block, q_ids, q_data in zip(*(batch[c] for c in ("dim", "ids", "data", "block", "q_ids", "q_data")), strict=True):
                at = block.as_py()
                if at not in best:
                    names[at] = q_ids.as_py()
                    best[at] = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=str)
                q = np.frombuffer(q_data.as_buffer()).reshape(-1, dim.as_py())
                m = np.frombuffer(data.as_buffer()).reshape(-1, dim.as_py())
                scores = np.maximum(0.0, np.round(q @ m.T, 9))
                least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(q), -1.0)
                row, column = np.nonzero(scores >= least[:, None])
                new = row, scores[row, column], np.array(ids.as_py(), dtype=str)[column]
                row, score, name = (np.concatenate(c) for c in zip(best[at], new, strict=True))
                order = np.lexsort((name, -score, row))
                row, score, name = row[order], score[order], name[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                best[at] = row[kept], score[kept], name[kept]
        for at, (row, score, name) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([names[at][r] for r in row.tolist()], pa.string()), pa.array(name.tolist(), pa.string()), pa.array(score)], names=["query_id", "id", "score"])

    hits = blocks.join(side, ["dim", "grp", "copy"]).select("dim", "ids", "data", "block", "q_ids", "q_data").mapInArrow(search, "query_id string, id string, score double")
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.withColumn("query_id", F.col("query_id").cast(queries.schema[query_id].dataType))
