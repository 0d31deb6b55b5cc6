"""Relations, concepts and the expansion against a queue-based search written here."""

import random
from collections import deque

from pyspark.sql import functions as F

from groundmesh.config import Config
from groundmesh.operators.concepts import concept_members, concept_nodes, concept_summaries, distinct_mentions
from groundmesh.operators.embeddings import relation_only_text
from groundmesh.operators.graph import adjacency, adjacency_blocks, expand_graph
from groundmesh.operators.relations import edges_from_sheet, relation_chunks
from groundmesh.sources.readers import read_sheet
from groundmesh.sources.store import checkpointed, upsert

REL = "relation_id string, source_id string, target_id string, relation_type string, description string, metadata struct<source_label:string,target_label:string,evidence:string>"


def test_sheet_to_edges(spark):
    raw = spark.createDataFrame([(1, "G", "P one", "a, , b", None), (2, None, None, None, None), (3, "G", "P one", "", "x"), (4, None, "P one", None, None)], "o int, `Functional Group (FG)` string, `Primary Work Object (PWO)` string, `Dependency Links` string, ` ` string")
    sheet = read_sheet(raw, F.col("o"), ("o",))
    assert [r.row_number for r in sheet.orderBy("row_number").collect()] == [2, 3, 4]
    edges = relation_chunks(edges_from_sheet(sheet, "FG & PWO", "book")).orderBy("metadata.row_number", "relation_type", "target_id").collect()
    assert [(e.source_id, e.relation_type, e.target_id) for e in edges] == [("p-one", "depends_on", "a"), ("p-one", "depends_on", "b"), ("g", "has_pwo", "p-one"), ("g", "has_pwo", "p-one"), ("unknown", "has_pwo", "p-one")]
    assert edges[2].description == "G has pwo P one."
    assert edges[2].metadata.evidence == "Functional Group (FG): G | Primary Work Object (PWO): P one | Dependency Links: a, , b"


def test_concept_nodes(spark):
    texts = spark.createDataFrame([("t2", "c", "Label", "f"), ("t1", "c", "Other", "f")], "id string, concept_id string, title string, source_file string")
    images = spark.createDataFrame([("i1", "d", "Image", "g")], "image_id string, concept_id string, title string, source_file string")
    rels = spark.createDataFrame([("r1", "c", "e", "has_task", "d", ("C", "E", ""))], REL)
    rows = {r.concept_id: r for r in concept_nodes(texts, images, rels).collect()}
    assert rows["c"].text_chunk_ids == ["t1", "t2"] and rows["c"].label == "Other" and rows["c"].source_relation_ids == ["r1"]
    assert rows["e"].metadata.retrieval_weight == 0.35 and rows["d"].metadata.has_evidence and rows["e"].label == "E"


def test_hub_members_come_in_bounded_parts(spark):
    """A concept that 200,000 relations and 30,000 chunks name: no row of members is over the bound, counts are exact, nodes equal those of the parts."""
    n = 200_000
    number = F.col("id").cast("string")
    texts = spark.range(30_000).select(F.concat(F.lit("t"), number).alias("id"), F.when(F.col("id") % 3 > 0, "hub").otherwise("c").alias("concept_id"), F.concat(F.lit("title "), number).alias("title"), F.concat(F.lit("f"), F.col("id") % 7).alias("source_file"))
    images = spark.createDataFrame([("i", "d", "Image", "g")], "image_id string, concept_id string, title string, source_file string")
    rels = spark.range(n).select(F.concat(F.lit("r"), number).alias("relation_id"), F.lit("hub").alias("source_id"), F.concat(F.lit("x"), F.col("id") % 50).alias("target_id"), F.lit("has_task").alias("relation_type"), F.lit("d").alias("description"), F.struct(F.lit("Hub").alias("source_label"), F.lit("X").alias("target_label"), F.lit("").alias("evidence")).alias("metadata"))
    distinct = distinct_mentions(texts, images, rels)
    members = concept_members(distinct, rows=1000)
    assert members.agg(F.max(F.size("ids"))).first()[0] <= 1000
    summary = {r.concept_id: r for r in concept_summaries(distinct).collect()}
    assert summary["hub"].metadata.source_relation_count == n and summary["hub"].metadata.text_chunk_count == 20_000 and summary["x7"].metadata.target_relation_count == n // 50
    held = {(r.concept_id, r.kind): (r.n, r.kinds) for r in members.select("concept_id", "kind", F.explode("ids").alias("id")).groupBy("concept_id", "kind").agg(F.count("id").alias("n"), F.count_distinct("id").alias("kinds")).collect()}
    assert held["hub", "source"] == (n, n) and held["hub", "title"] == (20_000, 20_000) and held["hub", "source_file"] == (7, 7) and held["d", "image"] == (1, 1) and held["x7", "relation_type"] == (1, 1)
    few = distinct_mentions(texts.limit(0), images, rels.where("relation_id < 'r11'"))
    whole = concept_nodes(texts.limit(0), images, rels.where("relation_id < 'r11'"))
    some = sorted(map(tuple, relation_only_text(whole, rels).collect()))
    assert some == sorted(map(tuple, relation_only_text(concept_summaries(few), rels, concept_members(few, rows=40)).collect())) and len(some) == 51


def search(seeds, edges, evidence, weights, cfg, terms=()):
    """Plain breadth-first search with the same rules; all scores rounded to nine digits."""
    near = {}
    for rid, s, t, kind, *said in edges:
        overlap = len(set(terms) & set(said[0].split())) if said else 0
        near.setdefault(s, []).append((rid, t, "out", kind, overlap))
        near.setdefault(t, []).append((rid, s, "in", kind, overlap))
    visited, kept, trace, dropped = set(seeds), set(), [], []
    queue = deque((c, 0) for c in sorted(seeds))
    while queue and len(kept) < cfg.relation_limit:
        c, depth = queue.popleft()
        if depth >= cfg.max_hops:
            continue
        rows = []
        for rid, n, way, kind, overlap in near.get(c, []):
            score = (0.35 * seeds.get(c, 0.5) + 0.25 * weights.get(kind, 0.5) + (0.2 if n in evidence else 0.0) + min(0.25, 0.04 * overlap)) * (1.0 if depth == 0 else 0.65)
            rows.append((-round(score, 9), rid, way, n))
        for minus, rid, way, n in sorted(rows):
            if len(kept) >= cfg.relation_limit:
                break
            if -minus < (0.28 if depth == 0 else 0.42):
                dropped.append(rid)
                continue
            if rid not in kept:
                kept.add(rid)
                trace.append((depth + 1, c, n, way, rid))
            if n not in visited:
                visited.add(n)
                if depth == 0 and -minus >= 0.5:
                    queue.append((n, 1))
    return trace, visited, dropped[:20]


def results(got):
    traces, visits, drops = {}, {}, {}
    for r in got["trace"].orderBy("seq").collect():
        traces.setdefault(r.query_id, []).append((r.hop, r.concept_id, r.neighbor_id, r.direction, r.relation_id))
    for r in got["visited"].collect():
        visits.setdefault(r.query_id, set()).add(r.concept_id)
    for r in got["dropped"].orderBy("drop_rank").collect():
        drops.setdefault(r.query_id, []).append(r.relation_id)
    return traces, visits, drops


def test_hubs_are_read_in_part(spark):
    """A hub of 3,000 edges, half of them without evidence behind, terms that few edges hold, and seeds around the limits."""
    rng = random.Random(11)
    kinds = ["depends_on", "has_pwo", "has_task", "other"]
    words = [f"t{i}" for i in range(12)] + [f"rare{i}" for i in range(400)]
    edges = [(f"r{i:04d}", *rng.sample(["hub", f"n{i % 900:03d}"], 2), rng.choice(kinds), " ".join(rng.choices(words, [20] * 12 + [1] * 400, k=3))) for i in range(3000)]
    edges += [(f"s{i:03d}", f"n{i:03d}", f"m{i % 7}", rng.choice(kinds), "t1 t2") for i in range(300)]
    names = sorted({n for _, s, t, *_ in edges for n in (s, t)})
    evidence = set(rng.sample(names, len(names) // 2))
    rels = spark.createDataFrame([(r, s, t, k, said, ("", "", "")) for r, s, t, k, said in edges], REL)
    nodes = spark.createDataFrame([(n, ["t"] if n in evidence else [], []) for n in names], "concept_id string, text_chunk_ids array<string>, image_ids array<string>")
    terms = {q: rng.sample(words, q % 9) for q in range(14)}
    queries = {q: {"hub": [0.0, 0.1, 0.2, 0.9][q % 4], **({rng.choice(names): 0.3} if q % 3 else {})} for q in terms}
    seeds = spark.createDataFrame([(q, n, s) for q, v in queries.items() for n, s in v.items()], "query_id long, concept_id string, seed_score double")
    asked = spark.createDataFrame(list(terms.items()), "query_id long, terms array<string>")
    for limit in (3, 30):
        cfg = Config(relation_limit=limit)
        blocks = adjacency_blocks(adjacency(rels), nodes, cfg, block_edges=40)
        assert blocks.agg(F.max("n"), F.sum("n")).first()[:] == (40, 2 * len(edges))
        got = expand_graph(seeds, blocks, asked, cfg, checkpointed)
        traces, visits, drops = results(got)
        for q, s in queries.items():
            trace, visited, dropped = search(s, edges, evidence, cfg.relation_weights, cfg, terms[q])
            assert (traces.get(q, []), visits[q], drops.get(q, [])) == (trace, visited, dropped), (limit, q)
        read = {(r.query_id, r.hop): (r.scored, r.degree) for r in got["read"].where("concept_id = 'hub'").collect()}
        assert all(degree == 3000 and scored <= degree for scored, degree in read.values())
        plain = [read[q, 1][0] for q in terms if not terms[q]]  # no terms: what is read is what is kept, and the rest of a block
        assert max(plain) <= 4 * limit + 20 + 80 and sum(s for s, _ in read.values()) < 0.7 * sum(d for _, d in read.values())


def test_expansion_equals_search(spark):
    rng = random.Random(5)
    kinds = ["depends_on", "has_pwo", "has_task", "other"]
    names = [f"n{i:02d}" for i in range(14)]
    edges = [(f"r{i:02d}", rng.choice(names), rng.choice(names), rng.choice(kinds)) for i in range(30)]
    evidence = set(rng.sample(names, 6))
    rels = spark.createDataFrame([(r, s, t, k, "", ("", "", "")) for r, s, t, k in edges], REL)
    nodes = spark.createDataFrame([(n, ["t"] if n in evidence else [], []) for n in names], "concept_id string, text_chunk_ids array<string>, image_ids array<string>")
    queries = {q: {n: round(rng.random(), 2) for n in rng.sample(names, rng.randint(1, 4))} for q in range(12)}
    seeds = spark.createDataFrame([(q, n, s) for q, v in queries.items() for n, s in v.items()], "query_id long, concept_id string, seed_score double")
    asked = spark.createDataFrame([(q, ["zzz"]) for q in queries], "query_id long, terms array<string>")
    for hops, limit in ((2, 30), (2, 4), (1, 30)):
        cfg = Config(max_hops=hops, relation_limit=limit)
        got = expand_graph(seeds, adjacency_blocks(adjacency(rels), nodes, cfg), asked, cfg)
        traces, visits, drops = results(got)
        for q, s in queries.items():
            trace, visited, dropped = search(s, edges, evidence, cfg.relation_weights, cfg)
            assert (traces.get(q, []), visits[q], drops.get(q, [])) == (trace, visited, dropped), (hops, limit, q)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = upsert(old, new, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upsert(once, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_control_point_edges_equal_their_sql(spark):
    import duckdb

    import __spark_entry__

    folder, db = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("lineitem", "orders"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = sorted(db.sql(__spark_entry__.oracle_sql()["control_point_edges"]).fetchall())
    got = sorted(map(tuple, __spark_entry__.queries()["control_point_edges"](spark, folder).collect()))
    assert got == want and len(got) == db.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
