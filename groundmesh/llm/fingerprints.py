"""Order MinHash fingerprints, and the likeness of documents to their edited texts and neighbours.

A text's k-mers (k code points) are numbered by occurrence. For each of ``HASHES`` hash functions the ``TUPLE`` minimal
(k-mer, occurrence) pairs are taken, put back into text order, and hashed as a tuple. Equal tuples need equal k-mers
in equal order, so the share of equal tuples falls with edit distance, not only with the overlap of k-mers.

Defined cases: a null text is the empty one; for texts shorter than k, k is the largest power of two that fits; where a text has
fewer pairs than the tuple, all are taken; two empty texts are alike (1.0), an empty and another text are not (0.0). Rows are ordered by
doc_id, ties by text; null doc_ids come last of all. A single document is its own neighbour. An empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundmesh.llm.common import shuffle_partitions, small

K = 8
HASHES = 32
TUPLE = 2
SEED = 20240229
NEIGHBOURS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Range buckets of the id order, per shuffle partition.
BUCKETS = 4

MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(SEED)
MULTIPLIERS = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
ADDENDS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def scramble(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmer_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every window of k code points, by doubling the window (k a power of two)."""
    h, factor, width = codes.astype(np.uint64) + np.uint64(1), MIX, 1
    k = min(k, 1 << (len(codes).bit_length() - 1)) if len(codes) < k else k
    while width < k:
        h = h[:-width] * factor + h[width:]
        factor, width = factor * factor, width * 2
    return h


def occurrences(h: np.ndarray) -> np.ndarray:
    """How often each value has come before, for every place."""
    n = len(h)
    if n < 1 << 20:
        # a sort of (44 hash bits, place) keeps places in order; two k-mers that agree in 44 bits of one text count as one
        packed = np.sort((h & ~np.uint64(0xFFFFF)) | np.arange(n, dtype=np.uint64))
        place, value = packed & np.uint64(0xFFFFF), packed >> np.uint64(20)
    else:
        place = np.argsort(h & ~np.uint64(0xFFFFF), kind="stable")
        value = h[place] >> np.uint64(20)
    index = np.arange(n)
    new = np.concatenate([[True], value[1:] != value[:-1]])
    out = np.empty(n, dtype=np.uint64)
    out[place] = index - np.maximum.accumulate(np.where(new, index, 0))
    return out


def order_min_hash(text: str, k: int = K) -> np.ndarray:
    """The fingerprint: one 32-bit tuple hash per hash function; empty for the empty text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return np.zeros(0, dtype=np.uint32)
    with np.errstate(over="ignore"):
        h = scramble(kmer_hashes(codes, k))
        pairs = (scramble(h + occurrences(h) * MIX) >> np.uint64(32)).astype(np.uint32)
        take = min(TUPLE, len(pairs))
        buffer = np.empty(len(pairs), dtype=np.uint32)
        places = np.empty((HASHES, take), dtype=np.int64)
        for i in range(HASHES):
            np.multiply(pairs, MULTIPLIERS[i], out=buffer)
            np.add(buffer, ADDENDS[i], out=buffer)
            for j in range(take):
                at = int(buffer.argmin())
                places[i, j] = at
                buffer[at] = 0xFFFFFFFF
        places.sort(axis=1)
        # ordered tuple: the pair's 64-bit k-mer hash and its occurrence enter through h and pairs
        picked = h[places] ^ pairs[places].astype(np.uint64)
        total = np.zeros(HASHES, dtype=np.uint64)
        for j in range(take):
            total = scramble(total * MIX + picked[:, j])
    return (total >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float(np.mean(a == b))


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def smaller(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are below value, by two short lists: runs of cuts, then one run."""
    if not cuts:
        return F.lit(0)
    size = math.isqrt(len(cuts)) + 1
    runs = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    listed = lambda x: F.array(*(F.lit(c).cast("long") for c in x))
    below = lambda x: F.size(F.filter(x, lambda c: c < value))
    run = below(listed([r[0] for r in runs]))
    return F.when(run == 0, 0).otherwise((run - 1) * size + below(F.element_at(F.array(*map(listed, runs)), run)))


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and likeness to both that and the next document.

    "Next" is descending doc_id order over the whole table. Ids are dealt into range buckets; the first document of each
    bucket is also sent to the bucket before it, so texts are shuffled once and no task holds more than a few rows
    at a time.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    buckets = BUCKETS * shuffle_partitions(spark)
    cuts = docs.agg(F.percentile_approx(-F.col("doc_id"), F.array(*(F.lit(i / buckets) for i in range(1, buckets))), F.lit(10_000)).alias("cuts")).first()["cuts"] or []
    cuts = sorted({int(c) for c in cuts})
    # a null id comes last, after every bucket
    bucket = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(smaller(-F.col("doc_id"), cuts))
    rows = docs.withColumn("bucket", bucket).withColumn("rank", F.coalesce(-F.col("doc_id"), F.lit((1 << 63) - 1)))
    heads = rows.groupBy("bucket").agg(F.min("rank").alias("rank")).collect()  # a row a bucket
    filled = sorted(heads, key=lambda r: r["bucket"])
    # the first rows of a bucket (ties included: the smallest text is the first) also end the bucket before it
    sent = [(r["bucket"], r["rank"], filled[i - 1]["bucket"]) for i, r in enumerate(filled)]
    ends = spark.createDataFrame(sent, "bucket int, rank long, goes_to int") if sent else None
    if ends is None:
        return docs.limit(0).mapInArrow(lambda batches: iter(()), NEIGHBOURS)
    tied = rows.join(F.broadcast(ends), ["bucket", "rank"]).groupBy("goes_to").agg(F.min("text").alias("text"))
    tails = tied.select(F.col("goes_to").alias("bucket"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("rank"), F.lit(1).alias("tail"))
    dealt = rows.select("bucket", "doc_id", "text", "rank", F.lit(0).alias("tail")).unionByName(tails)
    dealt = dealt.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "tail", "rank", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        done: tuple[str, np.ndarray] | None = None
        hexed = lambda x: x.astype(">u4").tobytes().hex()
        for batch in small(batches):
            rows = []
            for bucket, doc_id, text, tail in zip(*(batch[c].to_pylist() for c in ("bucket", "doc_id", "text", "tail")), strict=True):
                if before is not None and before[0] == bucket:
                    own = done[1] if done is not None and done[0] == before[2] else order_min_hash(before[2])
                    following = order_min_hash(text)
                    done = (text, following)
                    edited = edit(before[2], text)
                    new = own if edited == before[2] else order_min_hash(edited)
                    rows.append((before[1], len(before[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), hexed(own), hexed(new), likeness(own, new), likeness(own, following)))
                before = None if tail else (bucket, doc_id, text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return dealt.select("bucket", "doc_id", "text", "tail").mapInArrow(compare, NEIGHBOURS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every whole text."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            prints = [order_min_hash(x or "").astype(">u4").tobytes().hex() for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(one, "doc_id long, fingerprint string")
