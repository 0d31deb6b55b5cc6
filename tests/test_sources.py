import json

from pyspark.sql import functions as F

from groundmesh.functions.text import asset_url, parse_model_json
from groundmesh.operators.relations import edges_from_sheet, relation_chunks, workbook_relations
from groundmesh.schemas import MODEL_OUTPUT
from groundmesh.sources import store
from groundmesh.sources.readers import read_contexts, read_csv_sheet, read_pages


def test_pages(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>A</h1>\n<p>x</p>")
    (tmp_path / "b.txt").write_text("no")
    assert [tuple(r) for r in read_pages(spark, str(tmp_path)).collect()] == [("a.html", "<h1>A</h1>\n<p>x</p>")]


def test_csv_sheets(spark, tmp_path):
    (tmp_path / "s.csv").write_text(',,,\n Skill\xa0,Task ,,Task\n"a  b",c,x,second\n,,,\n,d,,\n"line\nbreak",e,,\n')
    rows = read_csv_sheet(spark, str(tmp_path / "s.csv"))
    assert rows.columns == ["row_number", "Skill", "Task"]
    assert [tuple(r) for r in rows.orderBy("row_number").collect()] == [(2, "a b", "second"), (3, "", ""), (4, "line break", "")]
    edges = workbook_relations({"Tasks": rows, "Unknown": rows}, "s.csv").orderBy("metadata.row_number").collect()
    assert [(e.source_id, e.target_id, e.description) for e in edges] == [("a-b", "second", "a b has task second."), ("unknown", "unknown", "has task ."), ("line-break", "unknown", "line break has task .")]
    assert edges[0].metadata.evidence == "Skill: a b | Task: second" and len({e.relation_id for e in edges}) == 3
    (tmp_path / "none.csv").write_text(",,\n , ,\n")
    assert read_csv_sheet(spark, str(tmp_path / "none.csv")).count() == 0


def test_listed_cells_and_repeated_edges(spark):
    sheet = spark.createDataFrame([(2, "G", "P", "x, y,, x ,")], "row_number int, `Functional Group (FG)` string, `Primary Work Object (PWO)` string, `Dependency Links` string")
    edges = edges_from_sheet(sheet, "FG & PWO", "f")
    assert sorted((e.source_id, e.relation_type, e.target_id) for e in edges.collect()) == [("g", "has_pwo", "p"), ("p", "depends_on", "x"), ("p", "depends_on", "y")]
    twice = edges.unionByName(edges.withColumn("description", F.lit("")))
    assert relation_chunks(twice).where("description <> ''").count() == relation_chunks(twice).count() == 3
    blank = edges_from_sheet(sheet.withColumn("Functional Group (FG)", F.lit("")), "FG & PWO", "f")
    assert relation_chunks(blank, drop_unknown=True).count() == 2


def test_tables_and_bundles(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "id string, title string")
    images = spark.createDataFrame([("i", "im")], "image_id string, title string")
    folder = str(tmp_path / "out")
    store.write_tables({"text": rows(("a", "1"), ("b", "2")), "image": images}, folder)
    store.write_tables({"text": rows(("b", "3"), ("c", "4")), "image": images.withColumn("title", F.lit("new"))}, folder, reset={"image"})
    assert sorted(map(tuple, store.stored(spark, f"{folder}/text").collect())) == [("a", "1"), ("b", "3"), ("c", "4")]
    assert store.stored(spark, f"{folder}/image").first().title == "new"
    wanted = rows(("b", "3"), ("z", "5"))
    assert tuple(store.insert_summary(wanted, store.stored(spark, f"{folder}/text"), "id").first()) == (2, 1, 1)
    text = spark.createDataFrame([(f"t{i}", f"T{i}", f"c{i % 3}", "f1" if i < 40 else "f2") for i in range(50)], "id string, title string, concept_id string, source_file string")
    none = spark.createDataFrame([], "image_id string, title string, concept_id string, source_file string")
    relations = spark.createDataFrame([("r", "c1", "other")], "relation_id string, source_id string, target_id string")
    items = store.module_items(text, none, relations, text.select("concept_id").distinct())
    assert {r.source_file: tuple(r)[1:] for r in store.module_bundle_sizes(items).collect()} == {"f1": (40, 0, 1, 3), "f2": (10, 0, 1, 3)}
    bundles = store.module_bundles(items, rows=10)
    assert bundles.where("source_file = 'f1' AND part = 'text_chunks'").count() == 4
    store.write_bundles(bundles, str(tmp_path / "bundles"))
    again = spark.read.json(str(tmp_path / "bundles")).select("source_file", "part", F.explode("items").alias("x"))
    assert again.where("part = 'text_chunks'").count() == 50 and again.where("part = 'relations'").count() == 2
    assert store.stored(spark, str(tmp_path / "nowhere")) is None


def test_contexts_and_model_output(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"query_id": 1, "text_blocks": [{"id": "a"}]}))
    assert read_contexts(spark, str(tmp_path / "c.json"), "query_id long, text_blocks array<struct<id:string>>").first().text_blocks[0].id == "a"
    body = json.dumps({"key_relations": [{"relation_id": "r"}]})
    texts = [body, f"```json\n{body}\n```", f"``` {body} ```", "none", None, "[1]"]
    got = [r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_model_json(F.col("t"), MODEL_OUTPUT).alias("m")).collect()]
    assert [bool(m) and m.key_relations[0].relation_id for m in got] == ["r", "r", "r", False, False, False]
    assert spark.range(1).select(asset_url(F.lit("x")).alias("u")).first().u == "/images/x.svg"


def test_bytes_that_are_no_text_are_left_out(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>caf\xc3\xa9 \xff\xfeb\xc3\x28ad</p>\r\nx\ry")
    (tmp_path / "b.html").write_bytes(b"\xff")
    assert {tuple(r) for r in read_pages(spark, str(tmp_path)).collect()} == {("a.html", "<p>café b(ad</p>\nx\ny"), ("b.html", "")}
