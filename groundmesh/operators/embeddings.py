"""Vectors of texts, queries and concepts.

The default encoder hashes terms with a sign into a fixed number of buckets: deterministic and without a model, so its
retrieval quality is not that of a trained one. Any callable from a list of texts to a matrix can take its place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmesh.functions.text import text
from groundmesh.operators.concepts import edge_nodes
from groundmesh.sources.snapshots import StoredTable
from groundmesh.sources.store import checkpointed

PASSAGE, QUERY = "passage: ", "query: "
TEXT_WEIGHT, IMAGE_WEIGHT = 1.0, 0.8
BATCH = 32
KNOWN_WORDS = 300_000
Encoder = Callable[[list[str]], np.ndarray]


def blake8(word: bytes) -> bytes:
    return hashlib.blake2b(word, digest_size=8).digest()


def hashing_encoder(dim: int = 64, digest: Callable[[bytes], bytes] = blake8) -> Encoder:
    """Signed feature hashing of lowered terms into ``dim`` buckets, L2-normalised. digest: eight bytes or more of a term's UTF-8."""
    term = re.compile(r"\w+")
    known: dict[str, int] = {}  # word -> 2 * bucket + sign

    def code(word: str) -> int:
        h = int.from_bytes(digest(word.encode("utf-8", "surrogatepass"))[:8], "little")
        return 2 * (h % dim) + (h >> 63)

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        if len(known) > KNOWN_WORDS:
            known.clear()
        for row, value in enumerate(texts):
            words = term.findall(value.lower())
            for word in set(words).difference(known):
                known[word] = code(word)
            counts = np.bincount(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)), minlength=2 * dim)
            out[row] = counts[1::2] - counts[::2]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return encode


def embed(df: DataFrame, text_col: str, make_encoder: Callable[[], Encoder] = hashing_encoder, prefix: str = PASSAGE, out: str = "vector") -> DataFrame:
    """Add ``out`` (array<float>): the prefixed text's vector, null where the text is blank. One encoder per task."""
    columns = df.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            filled = [i for i, t in enumerate(texts) if (t or "").strip()]
            vectors: list = [None] * len(texts)
            for start in range(0, len(filled), BATCH):
                part = filled[start : start + BATCH]
                for i, v in zip(part, encode([prefix + texts[i] for i in part]), strict=True):
                    vectors[i] = v.astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*columns, out])

    return df.mapInArrow(run, df.withColumn(out, F.lit(None).cast("array<float>")).schema)


def embed_stored(df: DataFrame, text_col: str, vectors: StoredTable, make_encoder: Callable[[], Encoder] = hashing_encoder, prefix: str = PASSAGE, out: str = "vector") -> DataFrame:
    """As ``embed``, with a store of vectors by content (key ``content``: SHA-256 of the prefixed text): only texts it lacks meet the encoder, each once.

    The vectors that are new are put into the store. One store serves one encoder.
    """
    shape = "content string, vector array<float>"
    content = F.when(F.trim(text(F.col(text_col))) != "", F.sha2(F.concat(F.lit(prefix), F.col(text_col)), 256))
    texts = df.select(content.alias("content"), F.col(text_col).alias("text")).where("content IS NOT NULL")
    known = vectors.read()
    known = df.sparkSession.createDataFrame([], shape) if known is None else known
    fresh = checkpointed(texts.join(known.select("content"), "content", "left_anti").groupBy("content").agg(F.min("text").alias("text")))
    if fresh.take(1):
        vectors.upsert(embed(fresh, "text", make_encoder, prefix).select("content", "vector"))
        known = vectors.read()
    found = known.select(F.col("content").alias("_content"), F.col("vector").alias(out))
    return df.withColumn("_content", content).join(found, "_content", "left").drop("_content")


def embed_queries(queries: DataFrame, make_encoder: Callable[[], Encoder] = hashing_encoder) -> DataFrame:
    """Queries with ``vector``, encoded with the prefix of queries."""
    return embed(queries, "query", make_encoder, QUERY)


def normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def evidence_vectors(text_vectors: DataFrame, image_vectors: DataFrame) -> DataFrame:
    """concept_id, vector: weighted mean of a concept's text and image vectors, L2-normalised.

    Ids were grouped by concept, so rows are grouped directly: one group by (concept, dimension) with partial sums, and
    one that puts the dimensions in order; hubs arrive as sums. A vector whose length differs from that of the
    concept's first (text before image, then by id) is ignored.
    """
    rows = text_vectors.select("concept_id", "id", F.col("vector").cast("array<double>").alias("v"), F.lit(TEXT_WEIGHT).alias("w"), F.lit(0).alias("rank")).unionByName(
        image_vectors.select("concept_id", "id", F.col("vector").cast("array<double>").alias("v"), F.lit(IMAGE_WEIGHT).alias("w"), F.lit(1).alias("rank"))
    )
    rows = rows.where((text(F.col("concept_id")) != "") & (F.size("v") > 0)).withColumn("dim", F.size("v"))
    per_dim = rows.groupBy("concept_id", "dim").agg(F.min(F.struct("rank", "id")).alias("first"), F.sum("w").alias("weight"))
    chosen = per_dim.groupBy("concept_id").agg(F.min_by(F.struct("dim", "weight"), "first").alias("c")).select("concept_id", "c.dim", "c.weight")
    spread = rows.select("concept_id", "dim", "w", F.posexplode("v").alias("at", "x")).groupBy("concept_id", "dim", "at").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
    means = spread.join(chosen, ["concept_id", "dim"]).groupBy("concept_id").agg(F.sort_array(F.collect_list(F.struct("at", (F.col("x") / F.col("weight")).alias("x")))).alias("v"))
    return means.select("concept_id", normalise(F.transform("v", lambda p: p["x"])).alias("vector"))


def relation_only_text(concepts: DataFrame, relations: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """concept_id, text of nodes without evidence: label, relation types, and up to ten descriptions.

    members: parts of ids, where concepts are summaries without arrays; the first ten of each part are looked at.
    """
    nodes = concepts.where(~F.col("metadata.has_evidence"))
    if members is None:
        nodes = nodes.select("concept_id", "label", F.col("metadata.relation_types").alias("types"), F.slice(F.concat("source_relation_ids", "target_relation_ids"), 1, 10).alias("ids"))
    else:
        first = members.where(F.col("kind").isin("source", "target")).select("concept_id", "kind", F.explode(F.slice("ids", 1, 10)).alias("id"))
        first = first.withColumn("_n", F.row_number().over(W.partitionBy("concept_id").orderBy("kind", "id"))).where("_n <= 10")
        ids = first.groupBy("concept_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"]).alias("ids"))
        types = members.where("kind = 'relation_type'").groupBy("concept_id").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("types"))
        nodes = nodes.select("concept_id", "label").join(ids, "concept_id", "left").join(types, "concept_id", "left")
    ids = nodes.select("concept_id", F.posexplode("ids").alias("at", "relation_id"))
    described = ids.join(relations.select("relation_id", "description"), "relation_id").where(text(F.col("description")) != "")
    listed = described.groupBy("concept_id").agg(F.sort_array(F.collect_list(F.struct("at", "description"))).alias("d"))
    return nodes.join(listed, "concept_id", "left").select("concept_id", node_text(F.transform("d", lambda x: x["description"])))


def node_text(descriptions: Column) -> Column:
    kinds = F.coalesce(F.array_join("types", ", "), F.lit(""))
    parts = F.array(text(F.col("label")), F.when(kinds != "", F.concat(F.lit("Relation types: "), kinds)).otherwise(""), F.coalesce(F.array_join(descriptions, " "), F.lit("")))
    return F.trim(F.array_join(F.filter(parts, lambda p: p != ""), " ")).alias("text")


def edge_node_text(relations: DataFrame, known: DataFrame) -> DataFrame:
    """The same straight from the edges, in one shuffle of their ends: concept_id, text of the concepts that no row of ``known`` (concept_id: those with evidence) names."""
    nodes = edge_nodes(relations).join(known.select("concept_id"), "concept_id", "left_anti")
    return nodes.select("concept_id", node_text(F.col("descriptions")))


def embed_concepts(concepts: DataFrame, text_vectors: DataFrame, image_vectors: DataFrame, relations: DataFrame, make_encoder: Callable[[], Encoder] = hashing_encoder, relation_vectors: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """Concepts with ``vector`` and metadata.embedding_source: from evidence, else from relations and label, else missing.

    relation_vectors (concept_id, vector): ready vectors of relation-only nodes, in place of encoding their texts.
    """
    from_evidence = evidence_vectors(text_vectors, image_vectors).withColumnRenamed("vector", "_evidence")
    if relation_vectors is None:
        relation_vectors = embed(relation_only_text(concepts, relations, members), "text", make_encoder)
    from_relations = relation_vectors.select("concept_id", F.col("vector").alias("_relations"))
    joined = concepts.join(from_evidence, "concept_id", "left").join(from_relations, "concept_id", "left")
    source = F.when(F.col("_evidence").isNotNull(), "linked_text_image_vectors").when(F.col("_relations").isNotNull(), "relation_label_text").otherwise("missing")
    vector = F.coalesce(F.col("_evidence").cast("array<float>"), "_relations")
    return joined.withColumn("metadata", F.col("metadata").withField("embedding_source", source)).withColumn("vector", vector).drop("_evidence", "_relations")


def embedding_summary(concepts: DataFrame) -> DataFrame:
    """embedding_source, n: how many concepts got their vector which way."""
    return concepts.groupBy(F.col("metadata.embedding_source").alias("embedding_source")).agg(F.count(F.lit(1)).alias("n"))


def skipped(collections: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """collection, id of the rows without a vector; collections: name -> (rows, key)."""
    return reduce(DataFrame.unionByName, (df.where("vector IS NULL").select(F.lit(name).alias("collection"), F.col(key).cast("string").alias("id")) for name, (df, key) in collections.items()))
