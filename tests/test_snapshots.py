"""Stored tables: commits, pinned readers, jobs that die, layers and compaction."""

import os
import random

import pytest
from pyspark.sql import functions as F

from groundmesh.sources import snapshots
from groundmesh.sources.snapshots import CommitConflict, StoredTable


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_and_pinned_readers(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"))
    assert t.read() is None and t.versions() == []
    t.overwrite(spark.range(3))
    pinned = t.read()
    t.overwrite(spark.range(5, 7))
    assert rows_of(pinned) == [(0,), (1,), (2,)] and rows_of(t.read()) == [(5,), (6,)] and rows_of(t.read(1)) == [(0,), (1,), (2,)]
    t.overwrite(t.read().withColumn("id", F.col("id") * 10))  # made from the table itself
    assert rows_of(StoredTable(spark, str(tmp_path / "t")).read()) == [(50,), (60,)] and t.versions() == [1, 2, 3]
    with pytest.raises(ValueError, match="no version 9"):
        t.read(9)
    with pytest.raises(ValueError, match="key"):
        t.upsert(spark.range(1))


def test_a_job_that_dies_leaves_the_old_version(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), key="id")
    t.overwrite(spark.range(4).withColumn("v", F.lit("old")))
    bad = spark.range(100).withColumn("v", F.when(F.col("id") == 99, F.raise_error(F.lit("dies in the middle"))).otherwise("new"))
    for write in (t.overwrite, t.upsert):
        with pytest.raises(Exception, match="dies in the middle"):
            write(bad)
        assert t.versions() == [1] and {r.v for r in t.read().collect()} == {"old"}
    (tmp_path / "t" / "data" / "killed").mkdir()  # what a driver that was killed leaves
    (tmp_path / "t" / "data" / "killed" / "part-0.parquet").write_bytes(b"half")
    (tmp_path / "t" / "manifests" / "staged-1").write_text("{")
    t.upsert(spark.range(2).withColumn("v", F.lit("new")))
    assert rows_of(t.read()) == [(0, "new"), (1, "new"), (2, "old"), (3, "old")]
    assert "killed" in t.vacuum(keep=1) and t.versions() == [2]
    assert "killed" not in os.listdir(tmp_path / "t" / "data") and "staged-1" not in os.listdir(tmp_path / "t" / "manifests")
    assert rows_of(t.read()) == [(0, "new"), (1, "new"), (2, "old"), (3, "old")]


def test_the_second_writer_of_a_version_is_told(spark, tmp_path):
    one, two = (StoredTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.overwrite(spark.range(1))
    now = one.snapshot()
    after = one._next(now, spark.range(1).schema, now.parts, None)
    two.overwrite(spark.range(2))
    with pytest.raises(CommitConflict):
        one._commit(after)
    assert two.read().count() == 2 and [f for f in os.listdir(tmp_path / "t" / "manifests") if "staged" in f] == []


def test_a_batch_is_written_once(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), key="id")
    assert t.upsert(spark.range(3), batch="a").version == 1
    first = t.upsert(spark.range(2, 5), batch="b")
    again = t.upsert(spark.range(2, 5), batch="b")
    assert first.written > 0 and (again.version, again.written) == (2, 0) and t.versions() == [1, 2] and t.read().count() == 5


def test_upserts_against_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "LAYERS", 3)
    rng, t, want, compacted = random.Random(4), StoredTable(spark, str(tmp_path / "t"), key="k", buckets=5), {}, 0
    for n in range(8):
        batch = {rng.randint(0, 60): f"{n}-{rng.random()}" for _ in range(rng.choice([1, 5, 40]))}
        done = t.upsert(spark.createDataFrame(list(batch.items()), "k long, v string"))
        want |= batch
        compacted += len(done.rewritten)
        assert rows_of(t.read()) == sorted(want.items())
    assert compacted > 0
    wider = spark.createDataFrame([(1, "w", 5), (1000, "n", 6)], "k long, v string, extra int")
    t.upsert(wider)
    got = {r.k: (r.v, r.extra) for r in t.read().collect()}
    assert got[1] == ("w", 5) and got[1000] == ("n", 6) and got[next(k for k in want if k != 1)][1] is None and len(got) == len(want | {1: 0, 1000: 0})
    asked = [k for k in list(want)[:3]] + [777]
    assert {r.k for r in t.rows_of(asked).collect()} == set(asked) - {777}
    assert t.rows_of([asked[0]]).inputFiles() and len(t.rows_of([asked[0]]).inputFiles()) < len(t.read().inputFiles())


def test_one_percent_in_writes_about_one_percent(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), key="k", buckets=8)
    rows = spark.range(40_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    whole = t.overwrite(rows)
    done = t.upsert(rows.where("k % 100 = 7").withColumn("v", F.sha2("v", 256)))
    assert 0.005 < done.written / whole.written < 0.03 and done.compacted == 0 and len(done.touched) == 8
    assert t.read().count() == 40_000 and t.read().where("k % 100 = 7").join(rows.select("k", F.sha2("v", 256).alias("v")), ["k", "v"]).count() == 400


def test_repeated_keys_null_keys_and_empty_writes(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), key="k")
    t.overwrite(spark.createDataFrame([], "k long, v string"))
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([(1, "a"), (1, "b"), (None, "n"), (None, "m")], "k long, v string"))
    assert sorted((r.k or -1) for r in t.read().collect()) == [-1, 1]
    t.upsert(spark.createDataFrame([(None, "z")], "k long, v string"))
    t.upsert(spark.createDataFrame([], "k long, v string"))
    assert {(r.k, r.v) for r in t.read().collect() if r.k is None} == {(None, "z")}


def test_other_formats(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), key="id", fmt="json")
    t.overwrite(spark.range(3).withColumn("s", F.struct(F.lit(1).alias("x"))))
    t.upsert(spark.range(2, 4).withColumn("s", F.struct(F.lit(2).alias("x"))))
    assert sorted((r.id, r.s.x) for r in t.read().collect()) == [(0, 1), (1, 1), (2, 2), (3, 2)]
