"""Sinks: artifact tables, per-file bundles, and a keyed store with idempotent writes."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmesh.functions.text import store_key
from groundmesh.schemas import KEYS, STORE_KINDS
from groundmesh.sources.snapshots import StoredTable, Written

#: Rows of one bundle, about.
BUNDLE_ROWS = 10_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where it is unset and Spark runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='groundmesh-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path in the checkpoint folder that nothing else takes."""
    return f"{checkpoint_folder(spark)}/groundmesh/{tag}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as Parquet to the folder of spark.checkpoint.dir and read from there: lineage ends, lost executors lose nothing, columns are pruned."""
    folder = new_folder(df.sparkSession, "step")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", reset: set[str] | None = None, keys: dict[str, str] | None = None, batch: str | None = None) -> dict[str, Written]:
    """Every table to its own stored table. ``reset``: the tables to write anew (None: all); rows of the others are put over the
    stored ones by their key. A failed write leaves a table as it was; a ``batch`` that was written before changes nothing."""
    done = {}
    for name, df in tables.items():
        table = StoredTable(df.sparkSession, f"{folder}/{name}", (keys or KEYS)[name], fmt=fmt)
        done[name] = table.overwrite(df, batch) if reset is None or name in reset else table.upsert(df, batch)
    return done


def stored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The stored table at path, at its newest version or the one named, or None if there is none."""
    return StoredTable(spark, path).read(version)


def with_store_key(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("uuid", store_key(STORE_KINDS[kind], F.col(KEYS[kind])))


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """One row per key, incoming rows over existing ones. Writing it to a fresh path twice changes nothing."""
    both = existing.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    others = sorted(c for c in both.columns if c not in (key, "_batch"))
    tie = F.xxhash64(*others) if others else F.lit(0)
    newest = W.partitionBy(key).orderBy(F.desc("_batch"), tie)
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_batch")


def insert_summary(incoming: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """attempted, inserted, failed: keys that were to be written, that are in the written table, and that are not; a null key counts as failed."""
    wanted = incoming.select(F.col(key).alias("k")).distinct()
    found = written.select(F.col(key).alias("k"), F.lit(1).alias("found")).distinct()
    out = wanted.join(found, "k", "left").agg(F.count(F.lit(1)).alias("attempted"), F.count("found").alias("inserted"))
    return out.withColumn("failed", F.col("attempted") - F.col("inserted"))


def module_concepts_of(text: DataFrame, images: DataFrame) -> DataFrame:
    """source_file, concept_id: the concepts that a file's chunks and images name."""
    both = text.select("source_file", "concept_id").union(images.select("source_file", "concept_id"))
    return both.where(F.col("concept_id").isNotNull()).distinct()


def module_relations(text: DataFrame, images: DataFrame, relations: DataFrame) -> DataFrame:
    """source_file, relation_id: relations with either end among the file's concepts (an OR as two equi-joins)."""
    own = module_concepts_of(text, images)
    ends = [relations.select("relation_id", F.col(c).alias("concept_id")) for c in ("source_id", "target_id")]
    return own.join(ends[0].union(ends[1]), "concept_id").select("source_file", "relation_id").distinct()


def module_concepts(text: DataFrame, images: DataFrame, concepts: DataFrame) -> DataFrame:
    return module_concepts_of(text, images).join(concepts.select("concept_id"), "concept_id").select("source_file", "concept_id").distinct()


def module_items(text: DataFrame, images: DataFrame, relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """source_file, part, id, title, concept_id: chunks and images of each file, and the relations and concepts that touch it, a row each."""
    none = F.lit(None).cast("string")
    parts = [
        text.select("source_file", F.lit("text_chunks").alias("part"), "id", "title", "concept_id"),
        images.select("source_file", F.lit("image_chunks").alias("part"), F.col("image_id").alias("id"), "title", "concept_id"),
        module_relations(text, images, relations).select("source_file", F.lit("relations").alias("part"), F.col("relation_id").alias("id"), none.alias("title"), none.alias("concept_id")),
        module_concepts(text, images, concepts).select("source_file", F.lit("concepts").alias("part"), F.col("concept_id").alias("id"), none.alias("title"), "concept_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def module_bundle_sizes(items: DataFrame) -> DataFrame:
    """A row per source file with the number of rows of each part: partial counts, no arrays."""
    size = lambda p: F.count(F.when(F.col("part") == p, 1)).cast("int").alias(p)
    return items.groupBy("source_file").agg(*map(size, ("text_chunks", "image_chunks", "relations", "concepts")))


def module_bundles(items: DataFrame, rows: int = BUNDLE_ROWS) -> DataFrame:
    """Bundles of at most about ``rows`` rows: source_file, part, number, items (array). A large file has many; none is held whole."""
    sizes = items.groupBy("source_file", "part").agg(F.ceil(F.count(F.lit(1)) / rows).alias("_of"))
    numbered = items.join(sizes, ["source_file", "part"]).withColumn("number", F.pmod(F.xxhash64("id"), F.col("_of")).cast("int"))
    return numbered.groupBy("source_file", "part", "number").agg(F.sort_array(F.collect_list(F.struct("id", "title", "concept_id"))).alias("items"))


def write_bundles(bundles: DataFrame, folder: str) -> None:
    """JSON files, a folder per source file."""
    bundles.write.mode("overwrite").partitionBy("source_file").json(folder)
