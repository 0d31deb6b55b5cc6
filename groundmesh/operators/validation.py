"""Checks of collections, contexts and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmesh.config import Config
from groundmesh.functions.text import text
from groundmesh.schemas import KEYS, REQUIRED
from groundmesh.sources.store import checkpointed


def missing_required(df: DataFrame, fields: tuple[str, ...], key: str) -> DataFrame:
    """Rows with a blank required field: the key and the fields' names."""
    names = F.array_compact(F.array(*(F.when(text(F.col(f)) == "", f) for f in fields)))
    return df.select(F.col(key).alias("key"), names.alias("missing")).where(F.size("missing") > 0)


def collection_checks(kind: str, df: DataFrame) -> DataFrame:
    """One row: collection, n, n_missing (rows lacking a required field), unique_keys, passed.

    Keys are counted by a hash of 64 bits, which is all that is shuffled: keys whose hashes differ differ. Only where a hash comes twice are the rows read
    again, and the keys of such hashes counted themselves.
    """
    key, fields = KEYS[kind], REQUIRED[kind]
    blank = reduce(lambda a, b: a | b, (text(F.col(f)) == "" for f in fields))
    code = F.when(text(F.col(key)) != "", F.xxhash64(F.col(key).cast("string")))
    hashed = df.select(code.alias("h"), blank.alias("blank")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.count_if("blank").alias("missing"))
    most = lambda n, known: F.coalesce(F.max(F.when(known, n)), F.lit(0)).alias("_most")
    out = checkpointed(hashed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("missing"), F.lit(0)).alias("n_missing"), most(F.col("n"), F.col("h").isNotNull())))
    if out.where("_most > 1").take(1):
        twice = checkpointed(hashed.where("h IS NOT NULL AND n > 1").select("h"))
        keyed = df.select(code.alias("h"), F.col(key).alias("k")).join(twice, "h", "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        out = out.drop("_most").crossJoin(keyed.agg(most(F.col("n"), F.lit(True))))  # a row each
    return out.select(F.lit(kind).alias("collection"), "n", "n_missing", (F.col("_most") <= 1).alias("unique_keys"), ((F.col("_most") <= 1) & (F.col("n_missing") == 0)).alias("passed"))


def validation_report(collections: dict[str, DataFrame]) -> DataFrame:
    """A row per collection, and one named ``all`` that passes if they all do; a rollup, so that every collection is read once."""
    rows = reduce(DataFrame.unionByName, (collection_checks(k, df) for k, df in collections.items()))
    total = rows.rollup("collection").agg(F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing"), F.bool_and("unique_keys").alias("unique_keys"), F.bool_and("passed").alias("passed"))
    return total.withColumn("collection", F.coalesce("collection", F.lit("all")))


def check_quality(contexts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (query_id, kind, phrases, n) over the titles of each query's text blocks -> query_id, kind, ok.

    any_of: a phrase is in the joined titles; none_of: none is; first_not: not in the first title; min_images, min_trace:
    at least n image blocks or traces.
    """
    titles = F.coalesce(F.transform("text_blocks", lambda b: F.lower(text(b["title"]))), F.array().cast("array<string>"))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    rows = rules.join(contexts.select("query_id", titles.alias("_titles"), size("image_blocks").alias("_images"), size("trace").alias("_trace")), "query_id")
    joined, first = F.array_join("_titles", " | "), F.coalesce(F.get("_titles", F.lit(0)), F.lit(""))
    within = lambda where: F.exists("phrases", lambda p: F.contains(where, p))
    ok = F.when(F.col("kind") == "any_of", within(joined)).when(F.col("kind") == "none_of", ~within(joined)).when(F.col("kind") == "first_not", ~within(first))
    ok = ok.when(F.col("kind") == "min_images", F.col("_images") >= F.col("n")).when(F.col("kind") == "min_trace", F.col("_trace") >= F.col("n"))
    return rows.select("query_id", "kind", F.coalesce(ok, F.lit(False)).alias("ok"))


def check_retrieval(contexts: DataFrame, quality: DataFrame, cfg: Config) -> DataFrame:
    """Per query: sizes, deepest hop, and passed (evidence found, limits kept, all quality checks true)."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    rows = contexts.select("query_id", size("text_blocks").alias("text_blocks"), size("image_blocks").alias("image_blocks"), size("relation_blocks").alias("relation_blocks"), F.coalesce(F.array_max(F.transform("trace", lambda t: t["hop"])), F.lit(0)).alias("max_seen_hop"))
    judged = quality.groupBy("query_id").agg(F.bool_and("ok").alias("quality_ok"))
    ok = (F.col("text_blocks") + F.col("image_blocks") > 0) & (F.col("max_seen_hop") <= cfg.max_hops) & (F.col("text_blocks") <= cfg.max_context_text) & (F.col("image_blocks") <= cfg.max_context_images) & (F.col("relation_blocks") <= cfg.max_context_relations)
    return rows.join(judged, "query_id", "left").withColumn("quality_ok", F.coalesce("quality_ok", F.lit(True))).withColumn("passed", ok & F.col("quality_ok"))


def check_answers(sizes: DataFrame, compact: DataFrame, answered: DataFrame) -> DataFrame:
    """Per query: compressed_smaller, has_evidence, citations and passed."""
    notes = F.col("compact_context.coverage_notes")
    evidence = compact.select("query_id", (notes["has_text_evidence"] | notes["has_image_evidence"]).alias("has_evidence"), notes["has_relation_trace"].alias("has_relation_trace"))
    rows = sizes.join(evidence, "query_id").join(answered.select("query_id", F.col("citation_count").alias("citations"), "uses_only_compressed_context"), "query_id")
    return rows.withColumn("passed", F.col("compressed_smaller") & F.col("has_evidence") & (F.col("citations") > 0) & F.col("uses_only_compressed_context"))


def concept_resolution(hits: DataFrame, items: DataFrame, concepts: DataFrame) -> DataFrame:
    """Hits (query_id, id, rank) with their concept and whether it is in the node table."""
    known = concepts.select("concept_id", F.lit(True).alias("found"))
    return hits.join(items.select("id", "concept_id"), "id").join(known, "concept_id", "left").select("query_id", "rank", "id", "concept_id", F.coalesce("found", F.lit(False)).alias("concept_found"))
