"""Extractive compression of contexts and grounded answers: array functions on one row per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundmesh.config import Config
from groundmesh.functions.text import citation, excerpt, language_signal, parse_model_json, text
from groundmesh.schemas import IMAGE_EVIDENCE, MODEL_OUTPUT, REFERENCE, RELATION_EVIDENCE, TEXT_EVIDENCE

# Sentences of the coverage notes and the answer.
NO_TEXT = "No text evidence was retrieved."
NO_IMAGE = "No image or diagram description evidence was retrieved."
NO_RELATION = "No relation trace was retrieved; answer should rely mainly on text/image evidence."
ANSWER_NOTE = "This draft is based mainly on retrieved course text/image evidence; no supporting relation trace was retrieved."


def first_by(blocks: Column, key: str, kind: str) -> Column:
    """Array without later entries of an id that came before; a null array is empty."""
    ids = F.transform(blocks, lambda x: F.coalesce(x[key], F.lit("")))
    kept = F.filter(blocks, lambda x, i: F.array_position(ids, F.coalesce(x[key], F.lit(""))) == i + 1)
    return F.coalesce(kept, F.array().cast(f"array<{kind}>")) if kind else kept


def coverage_notes(texts: Column, images: Column, relations: Column) -> Column:
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    weak = F.array_compact(F.array(*(F.when(~has(c), m) for c, m in ((texts, NO_TEXT), (images, NO_IMAGE), (relations, NO_RELATION)))))
    return F.struct(has(texts).alias("has_text_evidence"), has(images).alias("has_image_evidence"), has(relations).alias("has_relation_trace"), weak.alias("weaknesses"))


def compact_context(contexts: DataFrame, cfg: Config) -> DataFrame:
    """query_id, query, compact_context: the first texts, images and relations with excerpts, citations and references."""
    texts = F.slice(first_by(F.col("text_blocks"), "id", ""), 1, cfg.compact_text)
    images = F.slice(first_by(F.col("image_blocks"), "id", ""), 1, cfg.compact_images)
    relations = F.slice(first_by(F.col("relation_blocks"), "relation_id", ""), 1, cfg.compact_relations)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = contexts.select(
        "query_id", "query",
        F.coalesce(F.transform(texts, lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["concept_id"].alias("concept_id"), x["source_file"].alias("source_file"), excerpt(x["content"]).alias("excerpt"), citation(x["title"], x["concept_id"]).alias("citation"))), none(TEXT_EVIDENCE)).alias("t"),
        F.coalesce(F.transform(images, lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["concept_id"].alias("concept_id"), x["source_file"].alias("source_file"), excerpt(x["description"]).alias("description"), citation(x["title"], x["concept_id"]).alias("citation"))), none(IMAGE_EVIDENCE)).alias("i"),
        F.coalesce(F.transform(relations, lambda x: F.struct(*(x[c].alias(c) for c in ("relation_id", "source_id", "target_id", "relation_type", "description", "graph_relevance_score")))), none(RELATION_EVIDENCE)).alias("r"),
    )
    return rows.select("query_id", "query", _compact(F.col("t"), F.col("i"), F.col("r"), references(F.col("t"), F.col("i"))).alias("compact_context"), F.lit("extractive").alias("mode"))


def references(texts: Column, images: Column) -> Column:
    one = lambda x: F.struct(*(x[c].alias(c) for c in ("id", "title", "source_file", "concept_id")))
    return F.concat(F.transform(texts, one), F.transform(images, one))


def _compact(texts: Column, images: Column, relations: Column, refs: Column) -> Column:
    return F.struct(texts.alias("key_text_evidence"), images.alias("key_image_evidence"), relations.alias("key_relations"), refs.alias("source_references"), coverage_notes(texts, images, relations).alias("coverage_notes"))


def traceable_relations(candidates: Column, evidence: Column, cfg: Config) -> Column:
    """Candidates whose id is in the evidence, as the evidence has them; the first of the evidence where none is."""
    known = F.transform(evidence, lambda x: text(x["relation_id"]))
    found = F.filter(F.transform(candidates, lambda x: F.array_position(known, text(x["relation_id"]))), lambda p: p > 0)
    rows = F.transform(found, lambda p: F.get(evidence, p.cast("int") - 1))
    return F.slice(F.when(F.size(rows) > 0, rows).otherwise(evidence), 1, cfg.compact_relations)


def normalize_model_context(outputs: DataFrame, compact: DataFrame, cfg: Config) -> DataFrame:
    """Model outputs (query_id, response) over extractive contexts; those that are no object or lack a key fall back."""
    parsed = outputs.select("query_id", parse_model_json(F.col("response"), MODEL_OUTPUT).alias("m"))
    rows = compact.join(parsed, "query_id", "left")
    names = ("key_text_evidence", "key_image_evidence", "key_relations", "source_references")
    wrapped = F.col("m.compact_context").isNotNull()
    chosen = {n: F.when(wrapped, F.col(f"m.compact_context.{n}")).otherwise(F.col(f"m.{n}")) for n in names}
    valid = F.col("m").isNotNull()
    for n in names[:3]:
        valid = valid & chosen[n].isNotNull()
    own = F.col("compact_context")
    refs = F.when(F.coalesce(F.size(chosen["source_references"]), F.lit(0)) > 0, chosen["source_references"]).otherwise(own["source_references"])
    made = _compact(
        F.slice(chosen["key_text_evidence"], 1, cfg.compact_text), F.slice(chosen["key_image_evidence"], 1, cfg.compact_images),
        traceable_relations(chosen["key_relations"], own["key_relations"], cfg), refs.cast(f"array<{REFERENCE}>"),
    )
    return rows.select("query_id", "query", F.when(valid, made).otherwise(own).alias("compact_context"), F.when(valid, "model").otherwise(F.col("mode")).alias("mode"))


def answer_text(query: Column, compact: Column) -> Column:
    texts, images, relations = compact["key_text_evidence"], compact["key_image_evidence"], compact["key_relations"]
    bullets = lambda c, body: F.transform(c, lambda x: F.concat(F.lit("- "), text(x[body]), F.lit(" "), text(x["citation"])))
    edges = F.transform(relations, lambda x: F.concat(F.lit("- "), text(x["source_id"]), F.lit(" --"), text(x["relation_type"]), F.lit("--> "), text(x["target_id"]), F.lit(": "), text(x["description"])))
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.array(F.concat(F.lit("Query: "), text(query)), F.lit("")),
        F.when(~compact["coverage_notes"]["has_relation_trace"], F.array(F.lit(ANSWER_NOTE), F.lit(""))).otherwise(none),
        F.when(F.size(texts) > 0, F.concat(F.array(F.lit("Key course evidence:")), bullets(F.slice(texts, 1, 5), "excerpt"))).otherwise(none),
        F.when(F.size(images) > 0, F.concat(F.array(F.lit(""), F.lit("Relevant diagram/image evidence:")), bullets(F.slice(images, 1, 2), "description"))).otherwise(none),
        F.when(F.size(relations) > 0, F.concat(F.array(F.lit(""), F.lit("Relevant graph relation context:")), F.slice(edges, 1, 6))).otherwise(none),
    )
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def answers(compact: DataFrame) -> DataFrame:
    """One answer record per query: text, images with display type and asset link, citations, coverage, language, counts."""
    c = F.col("compact_context")
    images = F.transform(c["key_image_evidence"], lambda x: F.struct(x["id"].alias("image_id"), *(x[n].alias(n) for n in ("title", "concept_id", "source_file", "description", "citation")), F.lit("image_description").alias("display_type"), F.concat(F.lit("/images/"), x["id"], F.lit(".svg")).alias("asset_url")))
    return compact.select(
        "query_id", "query", answer_text(F.col("query"), c).alias("answer"), images.alias("retrieved_images"), c["source_references"].alias("citations"), c["coverage_notes"].alias("coverage_notes"),
        language_signal(F.col("query")).alias("language"), "mode", F.lit(True).alias("uses_only_compressed_context"), F.size(c["key_image_evidence"]).alias("image_evidence_count"), F.size(c["source_references"]).alias("citation_count"),
    )


def compression_ratio(contexts: DataFrame, compact: DataFrame) -> DataFrame:
    """query_id, retrieval_size, compressed_size, compressed_smaller: characters of both as JSON."""
    whole = contexts.select("query_id", F.length(F.to_json(F.struct(*contexts.columns))).alias("retrieval_size"))
    small = compact.select("query_id", F.length(F.to_json(F.struct("query", "compact_context"))).alias("compressed_size"))
    return whole.join(small, "query_id").withColumn("compressed_smaller", F.col("compressed_size") < F.col("retrieval_size"))
