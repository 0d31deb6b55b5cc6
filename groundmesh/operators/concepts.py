"""Concept nodes: everything that names a concept, grouped by its id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmesh.functions.text import clean_text, text
from groundmesh.sources.store import checkpointed

#: Ids of one row of members, at most.
MEMBER_ROWS = 10_000
KINDS, NAMES = ("text", "image", "source", "target"), ("source_file", "title", "relation_type")


def mentions(text_chunks: DataFrame, images: DataFrame, relations: DataFrame) -> DataFrame:
    """Long table of who names which concept; rank says which label wins (text, image, source, target)."""
    none = F.lit(None).cast("string")

    def named(concept: str, label: str, key: str, rank: int, kind: str, file: Column = none, title: Column = none, relation: Column = none) -> Column:
        order = F.struct(F.lit(rank).alias("rank"), F.col(key).alias("key"))
        return F.struct(F.col(concept).alias("concept_id"), F.col(label).alias("label"), order.alias("order"), F.lit(kind).alias("kind"), F.col(key).alias("id"), file.alias("source_file"), title.alias("title"), relation.alias("relation_type"))

    file, title, kind = F.col("source_file"), F.col("title"), F.col("relation_type")
    ends = F.array(named("source_id", "metadata.source_label", "relation_id", 2, "source", relation=kind), named("target_id", "metadata.target_label", "relation_id", 3, "target", relation=kind))
    parts = [
        text_chunks.select(named("concept_id", "title", "id", 0, "text", file, title).alias("m")),
        images.select(named("concept_id", "title", "image_id", 1, "image", file, title).alias("m")),
        relations.select(F.explode(ends).alias("m")),  # one pass over the edges
    ]
    return reduce(DataFrame.unionByName, (p.select("m.*") for p in parts)).where(text(F.col("concept_id")) != "")


def concept_keys(text_chunks: DataFrame, images: DataFrame, relations: DataFrame) -> DataFrame:
    """concept_id, label, node_type of every node, for checks of whether they are filled. Nothing but ids is shuffled: a node that no mention
    gives a label has its id for one, so that the label is as filled as the id, which stands for it here."""
    ids = [text_chunks.select("concept_id"), images.select("concept_id"), relations.select(F.explode(F.array("source_id", "target_id")).alias("concept_id"))]
    rows = reduce(DataFrame.unionByName, ids).where(text(F.col("concept_id")) != "").distinct()
    return rows.select("concept_id", F.col("concept_id").alias("label"), F.lit("concept").alias("node_type"))


def distinct_mentions(text_chunks: DataFrame, images: DataFrame, relations: DataFrame) -> DataFrame:
    """Mentions with those of one (concept, kind, id) in one row: what nodes and members are made of. Written, as several steps read it."""
    rows = mentions(text_chunks, images, relations)
    names = lambda c: F.array_sort(F.collect_set(F.when(text(F.col(c)) != "", F.col(c)))).alias(f"{c}s")
    return checkpointed(rows.groupBy("concept_id", "kind", "id").agg(F.min_by("label", "order").alias("label"), F.min("order").alias("order"), names("source_file"), names("title"), names("relation_type")))


def concept_summaries(distinct: DataFrame) -> DataFrame:
    """One row per concept out of ``distinct_mentions``: label, and metadata with counts, has_evidence and weight. Partial aggregates only: a hub is as small as any."""
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).cast("int").alias(kind)
    rows = distinct.groupBy("concept_id").agg(F.min_by("label", "order").alias("first_label"), *map(count, KINDS)).withColumn("first_label", clean_text(F.col("first_label")))
    evidence = (F.col("text") > 0) | (F.col("image") > 0)
    return rows.select(
        "concept_id",
        F.when(F.col("first_label") == "", F.col("concept_id")).otherwise(F.col("first_label")).alias("label"),
        F.lit("concept").alias("node_type"),
        F.struct(
            F.col("text").alias("text_chunk_count"), F.col("image").alias("image_count"), F.col("source").alias("source_relation_count"), F.col("target").alias("target_relation_count"),
            evidence.alias("has_evidence"), F.lit("not_embedded").alias("embedding_source"), F.when(evidence, 1.0).otherwise(0.35).alias("retrieval_weight"),
        ).alias("metadata"),
    )


def concept_members(distinct: DataFrame, rows: int = MEMBER_ROWS) -> DataFrame:
    """concept_id, kind, part, ids (sorted): the ids that name a concept, and its source_files, titles and relation_types, at most ``rows`` in a row.

    A hub has as many parts as it needs, dealt by hash; a part is half full on average, so that none is over the bound.
    """
    named = [distinct.select("concept_id", F.lit(c).alias("kind"), F.explode(f"{c}s").alias("id")).distinct() for c in NAMES]
    pairs = reduce(DataFrame.unionByName, [distinct.select("concept_id", "kind", "id"), *named])
    hubs = pairs.groupBy("concept_id", "kind").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    part = F.pmod(F.xxhash64("id"), F.coalesce(F.ceil(2 * F.col("_n") / rows), F.lit(1))).cast("int").alias("part")
    dealt = pairs.join(hubs, ["concept_id", "kind"], "left").select("concept_id", "kind", "id", part)
    return dealt.groupBy("concept_id", "kind", "part").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def packed(c: Column) -> tuple[Column, Column]:
    """(bytes of an id of 32 hex digits, any other id as it is): half the size for ids that are digests; ``unpacked`` puts them together."""
    bare = F.when(F.length(c) == 32, F.unhex(c))
    digest = F.lower(F.hex(bare)) == c
    return F.when(digest, bare), F.when(~F.coalesce(digest, F.lit(False)), c)


def unpacked(digest: Column, other: Column) -> Column:
    return F.coalesce(F.lower(F.hex(digest)), other)


def by_concept(text_chunks: DataFrame | None, images: DataFrame | None, relations: DataFrame, *more: str) -> DataFrame:
    """Mentions, all of a concept in one partition: concept_id, rank (place in KINDS), id, label, name (a chunk's file, an edge's type) and ``more`` columns of the edges.

    One shuffle of narrow rows: groupings and windows by concept that follow need no other.
    """
    none = [F.lit(None).cast("string").alias(c) for c in more]

    def chunks(df: DataFrame, key: str, rank: int) -> DataFrame:
        return df.select("concept_id", F.lit(rank).alias("rank"), F.col(key).alias("id"), F.col("title").alias("label"), F.col("source_file").alias("name"), *none)

    end = lambda side, rank: F.struct(F.col(f"{side}_id").alias("concept_id"), F.lit(rank).alias("rank"), F.col(f"metadata.{side}_label").alias("label"))
    ends = relations.select(F.explode(F.array(end("source", 2), end("target", 3))).alias("m"), F.col("relation_id").alias("id"), F.col("relation_type").alias("name"), *more)
    parts = [ends.select("m.concept_id", "m.rank", "id", "m.label", "name", *more)]  # one pass over the edges
    parts += [chunks(df, key, rank) for df, key, rank in ((text_chunks, "id", 0), (images, "image_id", 1)) if df is not None]
    digest, other = packed(F.col("id"))
    rows = reduce(DataFrame.unionByName, parts).where(text(F.col("concept_id")) != "")
    dealt = rows.select("concept_id", "rank", digest.alias("_digest"), other.alias("_other"), "label", "name", *more).repartition("concept_id")
    return dealt.select("concept_id", "rank", unpacked(F.col("_digest"), F.col("_other")).alias("id"), "label", "name", *more)


def node_label(first: Column) -> Column:
    """A node's label: that of its first mention, or its id where that is blank."""
    label = clean_text(first)
    return F.when(label == "", F.col("concept_id")).otherwise(label).alias("label")


def concept_nodes(text_chunks: DataFrame, images: DataFrame, relations: DataFrame) -> DataFrame:
    """One row per concept with label, metadata and sorted id arrays: whole nodes, for readers that want arrays. Mentions are shuffled once, nothing is written.

    Readers that can do without take ``concept_summaries`` and ``concept_members``, in which hubs are no larger than other rows.
    """
    rows, rank = by_concept(text_chunks, images, relations), F.col("rank")
    values = lambda what, known, name: F.array_sort(F.collect_set(F.when(known, F.col(what)))).alias(name)
    filled = lambda c: text(F.col(c)) != ""
    names = (values("name", filled("name") & (rank < 2), "source_files"), values("label", filled("label") & (rank < 2), "titles"), values("name", filled("name") & (rank >= 2), "relation_types"))
    held = rows.groupBy("concept_id").agg(F.min_by("label", F.struct("rank", "id")).alias("first_label"), *(values("id", rank == n, kind) for n, kind in enumerate(KINDS)), *names)
    evidence = (F.size("text") > 0) | (F.size("image") > 0)
    return held.select(
        "concept_id", node_label(F.col("first_label")), F.lit("concept").alias("node_type"),
        F.col("text").alias("text_chunk_ids"), F.col("image").alias("image_ids"), F.col("source").alias("source_relation_ids"), F.col("target").alias("target_relation_ids"),
        F.struct(
            "source_files", "titles", "relation_types", F.size("text").alias("text_chunk_count"), F.size("image").alias("image_count"), F.size("source").alias("source_relation_count"),
            F.size("target").alias("target_relation_count"), evidence.alias("has_evidence"), F.lit("not_embedded").alias("embedding_source"), F.when(evidence, 1.0).otherwise(0.35).alias("retrieval_weight"),
        ).alias("metadata"),
    )


def edge_nodes(relations: DataFrame, rows: int = 10) -> DataFrame:
    """concept_id, label, types (sorted), descriptions of every concept that edges name: those of its first ``rows`` edges, by side (source first), then id; blank ones out.

    Of a concept no more rows are held than that and one of each type.
    """
    mentions = by_concept(None, None, relations, "description").withColumn("_n", F.dense_rank().over(W.partitionBy("concept_id").orderBy("rank", "id")))
    once = W.partitionBy("concept_id", "rank", "id").orderBy("label", "name", "description")
    kind = W.partitionBy("concept_id", "name").orderBy("_n")
    few = mentions.withColumn("_kind", F.row_number().over(kind)).where((F.col("_n") <= rows) | (F.col("_kind") == 1)).withColumn("_once", F.row_number().over(once))
    told = (F.col("_n") <= rows) & (F.col("_once") == 1) & (text(F.col("description")) != "")
    held = few.groupBy("concept_id").agg(
        F.min_by("label", F.struct("_n", "_once")).alias("first_label"), F.array_sort(F.collect_set(F.when(text(F.col("name")) != "", F.col("name")))).alias("types"),
        F.array_sort(F.collect_list(F.when(told, F.struct("_n", "description")))).alias("d"),
    )
    return held.select("concept_id", node_label(F.col("first_label")), "types", F.transform("d", lambda x: x["description"]).alias("descriptions"))
