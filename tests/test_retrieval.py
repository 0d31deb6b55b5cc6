import numpy as np
import pytest
from pyspark.sql import functions as F

from groundmesh.config import Config
from groundmesh.operators import answers, evidence, lexical_index, retrieval, validation, vectors
from groundmesh.operators.embeddings import embed, embed_queries, embed_stored, evidence_vectors, hashing_encoder
from groundmesh.operators.vectors import vector_topk
from groundmesh.sources.snapshots import StoredTable

CFG = Config()


def test_vector_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8)).round(3)
    rows = [(f"d{i:03d}", v.tolist()) for i, v in enumerate(m)] + [("same", m[0].tolist()), ("zero", [0.0] * 8), ("none", None)]
    corpus = spark.createDataFrame(rows, "id string, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, m[i].tolist()) for i in range(4)], "query_id long, vector array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(4):
        scores = sorted([(-max(0.0, round(float(unit[q] @ unit[i]), 9)), f"d{i:03d}") for i in range(300)] + [(-max(0.0, round(float(unit[q] @ unit[0]), 9)), "same")])[:5]
        got = vector_topk(queries, corpus, 5).where(F.col("query_id") == q).orderBy("rank").collect()
        assert [(r.id, r.score) for r in got] == [(i, pytest.approx(-s)) for s, i in scores]


def test_lexical_scores_and_caps(spark):
    texts = spark.createDataFrame(
        [("a", "belt", "drift of the belt", "c1"), ("b", "x", "one1 two2 three3 four4 five5 six6 seven7 eight8 nine9 ten10", "c2"), ("n", None, None, None)], "id string, title string, content string, concept_id string"
    ).withColumn("source_file", F.lit("f")).withColumn("section_id", F.lit("s")).withColumn("type", F.lit("risk"))
    items = evidence.evidence_items(texts, None, CFG)
    queries = evidence.with_query_terms(spark.createDataFrame([(1, "belt drift"), (2, "one1 two2 three3 four4 five5 six6 seven7 eight8 nine9 ten10")], "query_id long, query string"), CFG)
    hits = {(r.query_id, r.id): r.score for r in evidence.lexical_topk(queries, items, CFG).collect()}
    assert hits == {(1, "a"): pytest.approx(0.45 + 0.08 + 0.08 + 0.3), (2, "b"): pytest.approx(0.70)}
    merged = evidence.merge_hits(spark.createDataFrame([(1, "text", "a", 0.91)], "query_id long, collection string, id string, score double"), evidence.lexical_topk(queries, items, CFG))
    assert {(r.id, r.source_rank) for r in merged.where("query_id = 1").collect()} == {("a", 0)}
    scored = {r.id: r for r in evidence.score_evidence(merged, items, queries, CFG).collect()}
    assert scored["a"].rerank_score == pytest.approx(0.91 + 0.05 + 0.06 + 0.08 + 0.3)
    assert "exact_domain_phrase=belt_drift" in scored["a"].ranking_reasons


def test_duplicates_and_generic(spark):
    schema = "query_id long, collection string, id string, fingerprint string, rerank_score double, generic_penalty double"
    seed = spark.createDataFrame([(1, "text", "a", "f1", 0.5, 0.0), (1, "text", "g", "f9", 0.6, 0.5), (1, "text", "h", "f8", 0.9, 0.5)], schema)
    more = spark.createDataFrame([(1, "text", "b", "f1", 0.9, 0.0), (1, "text", "c", "f9", 0.1, 0.0), (1, "image", "b", "f1", 0.2, 0.0)], schema)
    got = {(r.collection, r.id): r.verdict for r in evidence.mark_duplicates(seed, more).collect()}
    assert got == {("text", "a"): "kept", ("text", "g"): "generic", ("text", "h"): "kept", ("text", "b"): "duplicate", ("text", "c"): "kept", ("image", "b"): "kept"}


def context(spark):
    text = [("t1", "T", "c", "f", "body.", 0.5, ["r"]), ("t1", "again", "c", "f", "x", 0.4, ["r"])]
    schema = (
        "query_id long, query string, text_blocks array<struct<id:string,title:string,concept_id:string,source_file:string,content:string,rerank_score:double,ranking_reasons:array<string>>>, "
        "image_blocks array<struct<id:string,title:string,concept_id:string,source_file:string,description:string,rerank_score:double,ranking_reasons:array<string>>>, "
        "relation_blocks array<struct<relation_id:string,source_id:string,target_id:string,relation_type:string,description:string,graph_relevance_score:double>>, trace array<struct<hop:int>>"
    )
    relation = [("r1", "a", "b", "has_task", "A has task B.", 0.4)]
    return spark.createDataFrame([(1, "why?", text, None, relation, [(1,)]), (2, "none", None, None, None, None)], schema)


def test_compact_answer_and_checks(spark):
    contexts = context(spark)
    compact = answers.compact_context(contexts, CFG)
    rows = {r.query_id: r for r in answers.answers(compact).collect()}
    assert rows[1].answer == "Query: why?\n\nKey course evidence:\n- body. [T, concept: c]\n\nRelevant graph relation context:\n- a --has_task--> b: A has task B."
    assert rows[2].answer.startswith("Query: none\n\nThis draft") and len(rows[2].coverage_notes.weaknesses) == 3
    checks = {r.query_id: r.passed for r in validation.check_answers(answers.compression_ratio(contexts, compact), compact, answers.answers(compact)).collect()}
    assert checks[2] is False
    flat = '{"key_text_evidence": [], "key_image_evidence": [], "key_relations": [{"relation_id": "zzz"}]}'
    outputs = spark.createDataFrame([(1, f"```json\n{flat}\n```"), (2, "not json")], "query_id long, response string")
    made = {r.query_id: r for r in answers.normalize_model_context(outputs, compact, CFG).collect()}
    assert made[1].mode == "model" and made[1].compact_context.key_relations[0].relation_id == "r1" and len(made[1].compact_context.source_references) == 1
    assert made[2].mode == "extractive"
    rules = spark.createDataFrame([(1, "any_of", ["t"], 0), (1, "min_images", [], 1)], "query_id long, kind string, phrases array<string>, n long")
    quality = validation.check_quality(contexts, rules)
    assert {r.kind: r.ok for r in quality.collect()} == {"any_of": True, "min_images": False}
    assert {r.query_id: r.passed for r in validation.check_retrieval(contexts, quality, CFG).collect()} == {1: False, 2: False}


def test_concept_vectors_and_encoder(spark):
    texts = spark.createDataFrame([("c", "t1", [1.0, 0.0]), ("c", "t2", [1.0, 2.0, 3.0]), ("z", "t3", [0.0, 0.0])], "concept_id string, id string, vector array<double>")
    images = spark.createDataFrame([("c", "i1", [0.0, 1.0])], "concept_id string, id string, vector array<double>")
    got = {r.concept_id: r.vector for r in evidence_vectors(texts, images).collect()}
    norm = (1 + 0.64) ** 0.5
    assert got["c"] == [pytest.approx(1 / norm), pytest.approx(0.8 / norm)] and got["z"] == [0.0, 0.0]
    a = hashing_encoder()(["one two", "two one", ""])
    assert np.allclose(a[0], a[1]) and np.isclose(np.linalg.norm(a[0]), 1) and not a[2].any()


def test_only_new_texts_meet_the_encoder(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "vectors"), "content")
    rows = [(1, "belt drift"), (2, "belt drift"), (3, "  "), (4, None), (5, "other text")]
    texts = spark.createDataFrame(rows, "id long, t string")

    def refusing():
        def encode(texts):
            raise AssertionError(f"met the encoder: {texts}")

        return encode

    def only(allowed):
        def make():
            def encode(texts):
                assert set(texts) <= allowed and len(texts) == len(set(texts))
                return hashing_encoder()(texts)

            return encode

        return make

    shown = lambda df: sorted((r.id, r.vector) for r in df.collect())
    once = shown(embed_stored(texts, "t", table, only({"passage: belt drift", "passage: other text"})))
    assert once == shown(embed(texts, "t")) == shown(embed_stored(texts, "t", table, refusing)) and once[2][1] is None
    for (_, vector), (_, said) in zip(once, rows, strict=True):  # by value
        assert vector is None or np.allclose(vector, hashing_encoder()([f"passage: {said}"])[0], atol=1e-7)
    more = texts.unionByName(spark.createDataFrame([(6, "third text")], "id long, t string"))
    assert shown(embed_stored(more, "t", table, only({"passage: third text"}))) == shown(embed(more, "t"))
    asked = spark.createDataFrame([(1, "belt drift"), (2, "")], "query_id long, query string")
    found = {r.query_id: r.vector for r in embed_queries(asked).collect()}
    assert np.allclose(found[1], hashing_encoder()(["query: belt drift"])[0], atol=1e-7) and found[2] is None


def test_top_k_paths_agree(spark, monkeypatch):
    """Query terms and vectors beyond the broadcast limits go other ways to the same result."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)] + ["belt", "drift"]
    texts = spark.createDataFrame([(f"d{i}", " ".join(rng.choice(words, 3)), " ".join(rng.choice(words, 12)), "c", "f", "s", "x") for i in range(120)], "id string, title string, content string, concept_id string, source_file string, section_id string, type string").repartition(3)
    items = evidence.evidence_items(texts, texts.withColumnsRenamed({"id": "image_id", "content": "description"}), CFG)
    queries = evidence.with_query_terms(spark.createDataFrame([(i, " ".join(rng.choice(words, 4))) for i in range(9)] + [(99, "none of these"), (100, None)], "query_id long, query string"), CFG)
    rows = lambda df: sorted(map(tuple, df.collect()))
    shared = rows(evidence.lexical_topk(queries, items, CFG))
    assert max(r[4] for r in shared) == CFG.lexical_limit and {r[1] for r in shared} == {"text", "image"}
    monkeypatch.setattr(lexical_index, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(lexical_index, "PASS_TERMS", 12)
    assert rows(evidence.lexical_topk(queries, items, CFG)) == shared
    m = rng.normal(size=(150, 6))
    corpus = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(m)], "id string, vector array<double>").repartition(4)
    asked = spark.createDataFrame([(i, m[i].tolist()) for i in range(40)], "query_id long, vector array<double>")
    near = rows(vector_topk(asked, corpus, 7))
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    assert rows(vector_topk(asked, corpus, 7)) == near and len(near) == 40 * 7


def test_retrieval_switches(spark):
    texts = spark.createDataFrame([(f"t{i}", f"belt {i}", f"drift of belt {i} observed", f"c{i}", "f", f"s{i}", "risk", [1.0, float(i)]) for i in range(14)], "id string, title string, content string, concept_id string, source_file string, section_id string, type string, vector array<double>")
    images = spark.createDataFrame([("i1", "belt map", "a map", "c1", "f", "s1", "svg", [1.0, 0.5])], "image_id string, title string, description string, concept_id string, source_file string, section_id string, type string, vector array<double>")
    relations = spark.createDataFrame([(f"r{i}", f"c{i}", f"c{i + 1}", "has_task", f"belt {i} has task", (f"belt {i}", f"belt {i + 1}", "")) for i in range(13)], "relation_id string, source_id string, target_id string, relation_type string, description string, metadata struct<source_label:string,target_label:string,evidence:string>")
    from groundmesh.operators.concepts import concept_nodes

    nodes = concept_nodes(texts, images, relations.withColumn("metadata", F.col("metadata").withField("source_file", F.lit("f"))))
    nodes = nodes.withColumn("vector", F.array(F.lit(1.0), F.substring("concept_id", 2, 9).cast("double")))
    store = retrieval.Store(texts, images, nodes, relations)
    queries = spark.createDataFrame([(1, "belt drift", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    run = lambda **x: retrieval.retrieve(queries, store, Config(**x))
    whole, near, none, full, boosted = run(), run(max_hops=1), run(disable_graph=True), run(debug_full_context=True), run(use_type_boost=True)
    assert run(max_hops=0).trace.count() == none.trace.count() == 0 and none.visited.count() == none.seeds.count()
    assert {r.hop for r in near.trace.collect()} == {1} and {r.hop for r in whole.trace.collect()} <= {1, 2}
    assert whole.context.where("collection = 'text'").count() == 8 and full.context.where("collection = 'text'").count() > 8
    assert full.relation_blocks.count() == full.trace.count() >= whole.relation_blocks.count()
    score = lambda found: {r.id: r.rerank_score for r in found.hits.where("collection = 'text'").collect()}
    assert all(score(boosted)[k] == pytest.approx(v + 0.04) for k, v in score(whole).items())
    assert {r.concept_id for r in whole.expanded_nodes.collect()} == {r.concept_id for r in whole.visited.collect()}
    left = whole.marked.where("verdict <> 'kept'").count() + whole.dropped.count()
    assert retrieval.dropped_items(whole).count() == left and retrieval.diagnostics(whole).count() == 1
    assert retrieval.contexts(whole).first().trace[0].hop == 1


def test_validation(spark):
    df = spark.createDataFrame([("a", "c", "n"), ("a", "", "n"), (None, "x", "n")], "concept_id string, label string, node_type string")
    row = validation.collection_checks("concept", df).first()
    assert (row.n, row.n_missing, row.unique_keys, row.passed) == (3, 2, False, False)
    assert validation.validation_report({"concept": df.limit(0)}).where("collection = 'all'").first().passed
