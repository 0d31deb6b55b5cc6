"""The stored vector index against comparing every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundmesh.operators import vector_index
from groundmesh.operators.vector_index import VectorIndex, vector_search
from groundmesh.operators.vectors import vector_topk

CORPUS, ASKED = "id string, vector array<float>", "query_id long, vector array<double>"


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(12, 16))
    rows = [(f"v{i:04d}", [float(x) for x in (middle[i % 12] + 0.15 * rng.normal(size=16)) * rng.uniform(0.1, 9)]) for i in range(1500)]
    rows += [("zero1", [0.0] * 16), ("zero2", [0.0] * 16), ("null", None), ("none", []), (None, [1.0] * 16), ("dup1", rows[3][1]), ("dup0", rows[3][1])]
    rows += [(f"short{i}", [float(x) for x in rng.normal(size=3)]) for i in range(9)]
    asked = [(i, [float(x) for x in middle[i % 12] + 0.2 * rng.normal(size=16)]) for i in range(30)]
    asked += [(90, rows[3][1]), (91, [0.0] * 16), (92, None), (93, [1.0, 2.0, 3.0]), (94, [1.0] * 5), (95, [-x for x in rows[0][1]])]
    return spark.createDataFrame(rows, CORPUS).repartition(4), spark.createDataFrame(asked, ASKED)


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize(("k", "cells", "block"), [(1, None, 32), (10, 5, 16), (10, 300, 256), (4000, None, 64)])
def test_hits_are_those_of_comparing_all(tables, k, cells, block):
    corpus, asked = tables
    hits, _ = vector_search(asked, VectorIndex.write(corpus, cells=cells, block=block), k)
    assert rows_of(hits) == rows_of(vector_topk(asked, corpus, k))


def test_part_of_the_vectors_is_read(tables):
    corpus, asked = tables
    index = VectorIndex.write(corpus, block=16)
    near = asked.where("query_id < 30")
    share = []
    for k in (1, 5, 200):
        read = vector_search(near, index, k)[1].agg(F.sum("vectors_read"), F.sum("blocks_read")).first()
        share.append(read[0] / (30 * 1504))
    assert share == sorted(share) and share[0] < 0.2


def test_blocks_hold_every_vector_once(tables):
    rows = VectorIndex.write(tables[0], block=20).blocks.collect()
    ids = [i for r in rows for i in r.ids]
    assert len(ids) == len(set(ids)) == 1500 + 4 + 9 and all(r.n == len(r.ids) <= 20 and r.low <= r.high and r.first_id == min(r.ids) and len(r.data) == 8 * r.dim * r.n for r in rows)


def test_passes_shuffled_joins_and_a_reopened_index(spark, tables, monkeypatch, tmp_path):
    corpus, asked = tables
    monkeypatch.setattr(vector_index, "PASS_BYTES", 8 * 16 * 13)
    monkeypatch.setattr(vector_index, "BROADCAST_PAIRS", 0)
    VectorIndex.write(corpus, str(tmp_path / "index"), block=40)
    assert rows_of(vector_search(asked, VectorIndex.stored(spark, str(tmp_path / "index")), 7)[0]) == rows_of(vector_topk(asked, corpus, 7))


def test_no_vectors_and_no_queries(spark, tables):
    corpus, asked = tables
    for c, a in ((corpus.limit(0), asked), (corpus, asked.limit(0))):
        hits, read = vector_search(a, VectorIndex.write(c), 3)
        assert hits.count() == 0 and read.count() == 0
