"""Evidence candidates and their ranking: lexical top-k, merge, rerank, node rerank, seeds, dedupe, context."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmesh.config import Config
from groundmesh.functions.text import fingerprint, generic_penalty, item_text, query_terms, term_set, text
from groundmesh.operators.lexical_index import DIGITS, LexicalIndex, lexical_search


def rounded(c: Column) -> Column:
    return F.round(c, DIGITS)


def with_query_terms(queries: DataFrame, cfg: Config) -> DataFrame:
    """query_id, query, terms (and vector, where queries have one)."""
    return queries.withColumn("terms", query_terms(F.col("query"), cfg))


def evidence_items(text_chunks: DataFrame | None, image_chunks: DataFrame | None, cfg: Config) -> DataFrame:
    """Chunks of both kinds in one shape, with their term sets, generic penalty and fingerprint worked out once."""
    parts = []
    for kind, df, key, body in (("text", text_chunks, "id", "content"), ("image", image_chunks, "image_id", "description")):
        if df is not None:
            content, description = (F.col(body), F.lit("")) if kind == "text" else (F.lit(""), F.col(body))
            whole = item_text(F.col("title"), content, description)
            parts.append(df.select(
                F.lit(kind).alias("collection"), F.col(key).alias("id"), "concept_id", "title", F.col(body).alias("body"), "source_file", "section_id", "type",
                term_set(whole).alias("item_terms"), term_set(F.col("title")).alias("title_terms"), generic_penalty(whole, cfg).alias("generic_penalty"), F.sha2(fingerprint(whole), 256).alias("fingerprint"),
            ))
    return reduce(DataFrame.unionByName, parts)


def lexical_topk(queries: DataFrame, items: DataFrame | LexicalIndex, cfg: Config) -> DataFrame:
    """query_id, collection, id, score, rank: best lexical candidates of every query in every collection, whole tables.

    Items that are not indexed yet are, in the checkpoint folder; see lexical_index.
    """
    index = items if isinstance(items, LexicalIndex) else LexicalIndex.write(items)
    return lexical_search(queries, index, cfg)[0]


def merge_hits(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """One hit per (query_id, collection, id): the higher score; on equal scores the primary one."""
    cols = ["query_id", "collection", "id", "score"]
    both = primary.select(*cols, F.lit(0).alias("source_rank")).unionByName(secondary.select(*cols, F.lit(1).alias("source_rank")))
    best = W.partitionBy("query_id", "collection", "id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "source_rank")
    return both.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def score_evidence(hits: DataFrame, items: DataFrame, queries: DataFrame, cfg: Config, graph_relevance: float = 0.0) -> DataFrame:
    """Hits (query_id, collection, id, score) with item columns, rerank_score, ranking_reasons and penalty."""
    rows = hits.join(items, ["collection", "id"]).join(queries.select("query_id", "terms"), "query_id")
    overlap = F.array_intersect("terms", "item_terms")
    listed = F.array(*(F.lit(t) for t in cfg.operational_terms)) if cfg.operational_terms else F.array().cast("array<string>")
    rows = rows.withColumn("_o", overlap).withColumn("_n", F.size("_o")).withColumn("_t", F.size(F.array_intersect("terms", "title_terms"))).withColumn("_p", F.size(F.array_intersect("_o", listed)))
    bonus = F.least(F.lit(0.16), 0.025 * F.col("_n")) + F.least(F.lit(0.18), 0.06 * F.col("_t")) + F.least(F.lit(0.12), 0.04 * F.col("_p"))
    reasons = [F.when(F.col(c) > 0, F.concat(F.lit(f"{name}="), F.col(c).cast("string"))) for c, name in (("_n", "query_overlap"), ("_t", "title_overlap"), ("_p", "operational_overlap"))]
    for p in cfg.phrases:
        both = F.size(F.array_intersect("_o", F.array(*(F.lit(t) for t in p.terms)))) == len(p.terms)
        bonus = bonus + F.when(both, p.boost).otherwise(0.0)
        reasons.append(F.when(both, "exact_domain_phrase=" + "_".join(p.terms)))
    if cfg.use_type_boost:
        boosted = F.coalesce(F.col("type").isin("risk", "procedure"), F.lit(False))
        bonus = bonus + F.when(boosted, 0.04).otherwise(0.0)
        reasons.append(F.when(boosted, F.concat(F.lit("type_boost="), F.col("type"))))
    if graph_relevance:
        bonus = bonus + graph_relevance
        reasons.append(F.lit(f"graph_relevance={graph_relevance:.2f}"))
    reasons.append(F.when(F.col("generic_penalty") > 0, F.format_string("generic_penalty=%.2f", F.col("generic_penalty"))))
    score = F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0)) + bonus - F.col("generic_penalty"))
    out = rows.withColumn("rerank_score", rounded(score)).withColumn("ranking_reasons", F.array_compact(F.array(*reasons))).withColumn("graph_relevance_score", F.lit(graph_relevance))
    return out.drop("_o", "_n", "_t", "_p", "terms", "item_terms", "title_terms")


def top_evidence(scored: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The best of each query and collection, by rerank_score then id."""
    limit = F.coalesce(*(F.when(F.col("collection") == k, n) for k, n in limits.items()), F.lit(0))
    best = W.partitionBy("query_id", "collection").orderBy(F.desc("rerank_score"), "id")
    return scored.withColumn("hit_rank", F.row_number().over(best)).where(F.col("hit_rank") <= limit)


def rerank_nodes(hits: DataFrame, concepts: DataFrame) -> DataFrame:
    """Node hits with retrieval_weight, rerank_score and both ranks (by vector, by weighted score)."""
    weight = F.col("metadata.retrieval_weight")
    nodes = concepts.select(F.col("concept_id").alias("id"), "label", F.when(F.coalesce(weight, F.lit(0.0)) == 0, 0.35).otherwise(weight).alias("retrieval_weight"), F.col("metadata.has_evidence").alias("has_evidence"))
    rows = hits.join(nodes, "id").withColumn("rerank_score", rounded(F.coalesce("score", F.lit(0.0)) * F.col("retrieval_weight")))
    rows = rows.withColumn("vector_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return rows.withColumn("node_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "vector_rank"))).withColumnRenamed("id", "concept_id").drop("rank")


def relation_only_seeds(ranked: DataFrame, cfg: Config) -> DataFrame:
    """The first nodes by vector without evidence, not among those shown, with a raw score of at least the limit."""
    shown = ranked.where(F.col("node_rank") <= cfg.node_top_k).select("query_id", "concept_id")
    rest = ranked.where(~F.coalesce("has_evidence", F.lit(False)) & (F.col("score") >= cfg.seed_min_score)).join(shown, ["query_id", "concept_id"], "left_anti")
    return rest.withColumn("seed_rank", F.row_number().over(W.partitionBy("query_id").orderBy("vector_rank"))).where(F.col("seed_rank") <= cfg.seed_limit)


def seed_scores(*hits: DataFrame) -> DataFrame:
    """query_id, concept_id, seed_score: distinct concepts of all hits with their best rerank score (score where that is 0)."""
    best = F.coalesce(F.when(F.col("rerank_score") != 0, F.col("rerank_score")), F.when(F.col("score") != 0, F.col("score")), F.lit(0.0))
    rows = [h.where(text(F.col("concept_id")) != "").select("query_id", "concept_id", best.alias("s")) for h in hits]
    return reduce(DataFrame.unionByName, rows).groupBy("query_id", "concept_id").agg(F.max("s").alias("seed_score"))


def expanded_evidence(visited: DataFrame, seed_hits: DataFrame, items: DataFrame, queries: DataFrame, cfg: Config, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All items of the visited concepts but the seed hits, scored with graph relevance 0.2 and no base score. ``keep`` is applied to their ids."""
    found = visited.select("query_id", "concept_id").join(items.select("collection", "id", "concept_id"), "concept_id").select("query_id", "collection", "id")
    fresh = keep(found.join(seed_hits.select("query_id", "collection", "id"), ["query_id", "collection", "id"], "left_anti"))
    return score_evidence(fresh.withColumn("score", F.lit(None).cast("double")), items, queries, cfg, 0.2)


def mark_duplicates(seed_hits: DataFrame, expanded: DataFrame) -> DataFrame:
    """Both tables in one, with ``verdict``: kept, generic or duplicate. Seed hits come before expanded evidence."""
    shared = [c for c in seed_hits.columns if c in expanded.columns]
    rows = seed_hits.select(*shared, F.lit(0).alias("origin")).unionByName(expanded.select(*shared, F.lit(1).alias("origin")))
    generic = (F.col("generic_penalty") >= 0.5) & (F.col("rerank_score") < 0.85)
    order = ["origin", F.desc("rerank_score"), "id"]
    # a generic row never blocks another, so it is numbered apart
    rows = rows.withColumn("_generic", generic).withColumn("_id", F.row_number().over(W.partitionBy("query_id", "collection", "id", "_generic").orderBy(*order)))
    first = F.col("_generic") | (F.col("_id") > 1)
    rows = rows.withColumn("_aside", first).withColumn("_print", F.row_number().over(W.partitionBy("query_id", "collection", "fingerprint", "_aside").orderBy(*order)))
    verdict = F.when(F.col("_generic"), "generic").when((F.col("_id") > 1) | (F.col("_print") > 1), "duplicate").otherwise("kept")
    return rows.withColumn("verdict", verdict).drop("_generic", "_id", "_aside", "_print")


def context_items(marked: DataFrame, cfg: Config) -> DataFrame:
    """Kept evidence by rerank_score, cut to the context's limits (not in debug mode)."""
    best = W.partitionBy("query_id", "collection").orderBy(F.desc("rerank_score"), "origin", "id")
    rows = marked.where("verdict = 'kept'").withColumn("context_rank", F.row_number().over(best))
    if cfg.debug_full_context:
        return rows
    return rows.where(F.col("context_rank") <= F.when(F.col("collection") == "text", cfg.max_context_text).otherwise(cfg.max_context_images))
