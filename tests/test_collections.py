"""Checks and nodes of the sheets' edges, without tables of all edges in between."""

from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__
from groundmesh.config import Config
from groundmesh.operators import retrieval, validation
from groundmesh.operators.concepts import concept_members, concept_nodes, concept_summaries, distinct_mentions
from groundmesh.operators.embeddings import edge_node_text, relation_only_text
from groundmesh.sources.store import checkpoint_folder

SMALL = "/root/testdata/sf0.001"


def steps(spark):
    return set(Path(checkpoint_folder(spark).removeprefix("file://")).glob("groundmesh/step-*"))


def written(spark, before):
    """Rows of the tables that were written since."""
    return [spark.read.parquet(f"file://{x}").count() for x in steps(spark) - before]


def against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in Path(SMALL).glob("*.parquet"):
        db.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}{'/*.parquet' if table.is_dir() else ''}'")
    rows = __spark_entry__.queries()[name](spark, SMALL)
    cursor = db.execute(__spark_entry__.oracle_sql()[name])
    at = [[c[0] for c in cursor.description].index(c) for c in rows.columns]
    return sorted(map(tuple, rows.collect())), sorted(tuple(r[i] for i in at) for r in cursor.fetchall())


def test_validation_writes_no_edges(spark):
    """all that is written is a row of sums for each collection."""
    before = steps(spark)
    got, want = against_sql(spark, "collection_validation")
    assert got == want and written(spark, before) == [1, 1, 1, 1]


def test_keys_that_share_a_hash(spark, monkeypatch):
    rows = lambda *ids: spark.createDataFrame([(i, "l", "n") for i in ids], "concept_id string, label string, node_type string")
    monkeypatch.setattr(validation.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    check = lambda df: validation.collection_checks("concept", df).first()[1:4]
    assert check(rows("a", "b", None, "")) == (4, 2, True) and check(rows("a", "b", "b", None)) == (4, 1, False)


def test_nodes_are_made_without_tables_in_between(spark):
    """nodes equal their SQL, and no mentions are written."""
    before = steps(spark)
    got, want = against_sql(spark, "concept_node_table")
    assert got == want and written(spark, before) == []


def test_node_texts_are_made_without_tables_in_between(spark):
    """texts equal their SQL, and neither edges nor mentions are written."""
    before = steps(spark)
    got, want = against_sql(spark, "relation_only_node_text")
    assert got == want and written(spark, before) == []


def test_node_texts_equal_those_of_whole_nodes(spark):
    """Loops, repeated and blank rows, ids that are digests and others, hubs of many types, concepts with evidence."""
    digest = F.when(F.col("id") % 3 == 0, F.upper(F.md5(F.col("id").cast("string")))).when(F.col("id") % 3 == 1, F.md5(F.col("id").cast("string"))).otherwise(F.concat(F.lit("r"), "id"))
    end = lambda by: F.concat(F.lit("c"), F.col("id") % by)
    rels = spark.range(400).select(digest.alias("relation_id"), end(3).alias("source_id"), F.when(F.col("id") % 50 == 0, "").otherwise(end(7)).alias("target_id"), F.concat(F.lit("type"), F.col("id") % 13).alias("relation_type"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("d"), "id")).alias("description"), F.struct(F.when(F.col("id") % 2 > 0, F.concat(F.lit("L "), end(3))).alias("source_label"), F.lit(" ").alias("target_label")).alias("metadata"))
    rels = rels.unionByName(rels.where("description IS NULL"))
    texts = spark.createDataFrame([("t", "c5", "T", "f")], "id string, concept_id string, title string, source_file string")
    images = spark.createDataFrame([("i", "c9", "I", None)], "image_id string, concept_id string, title string, source_file string")
    nodes = concept_nodes(texts, images, rels)
    distinct = distinct_mentions(texts, images, rels)
    summary = {r.concept_id: r for r in concept_summaries(distinct).collect()}
    for r in nodes.collect():
        m = summary[r.concept_id]
        assert r.label == m.label and r.metadata.has_evidence == m.metadata.has_evidence
        assert tuple(map(len, (r.text_chunk_ids, r.image_ids, r.source_relation_ids, r.target_relation_ids))) == m.metadata[:4] == r.metadata[3:7]
    want = sorted(map(tuple, relation_only_text(concept_summaries(distinct), rels.dropDuplicates(["relation_id"]), concept_members(distinct)).collect()))
    assert sorted(map(tuple, edge_node_text(rels, nodes.where("metadata.has_evidence")).collect())) == want and len(want) == 6


def test_no_texts_are_written_by_retrieval(spark):
    """F8-F16: of the documents' texts only those of the context's rows are in any table that is written, and items that share an id count once."""
    before = steps(spark)
    shape = "id string, title string, content string, concept_id string, source_file string, section_id string, type string, vector array<double>"
    texts = spark.createDataFrame([(f"t{min(i, 38)}", f"belt {i}", f"drift of belt {i} observed {'x' * i}", f"c{i}", "f", f"s{i}", "risk", [1.0, float(i)]) for i in range(40)], shape)
    images = texts.limit(0).withColumnsRenamed({"id": "image_id", "content": "description"})
    relations = spark.createDataFrame([("r", "c0", "c1", "has_task", "belt", ("a", "b", ""))], "relation_id string, source_id string, target_id string, relation_type string, description string, metadata struct<source_label:string,target_label:string,evidence:string>")
    nodes = concept_nodes(texts, images, relations).withColumn("vector", F.array(F.lit(1.0), F.substring("concept_id", 2, 9).cast("double")))
    stored = retrieval.Store(texts.drop("vector"), images.drop("vector"), nodes, relations, texts.select("id", "concept_id", "vector"), images.select("image_id", "vector"))
    queries = spark.createDataFrame([(1, "belt drift", [0.0, 1.0])], "query_id long, query string, vector array<double>")
    blocks = retrieval.contexts(retrieval.retrieve(queries, stored, Config())).first().text_blocks
    assert len(blocks) == len({b.id for b in blocks}) > 2 and all(b.content.startswith("drift of belt") for b in blocks)
    tables = [spark.read.parquet(f"file://{x}") for x in steps(spark) - before]
    assert [t.count() for t in tables if {"body", "content"} & set(t.columns)] == [len(blocks)]
