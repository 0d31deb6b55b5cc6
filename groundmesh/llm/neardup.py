"""Near-duplicates by banded MinHash with sequential Bayesian verification.

1. Every whole text becomes its set of distinct 5-word shingles (64-bit hashes), a 128-bit hash of that set, and a
   signature of HASHES MinHash values. Texts with equal sets are one class, represented by the smallest doc_id.
2. Representatives that agree in one of BANDS bands of ROWS values share a bucket. A pair at the threshold shares none
   with chance (1 - 0.75**ROWS)**BANDS, about 6e-5.
3. Every bucket has a leader, a different one in every bucket, and each member is a candidate with its leader: linear
   in the bucket. The first FIRST_BANDS bands come first, then all bands with one member per component and bucket. Candidates are compared in batches of signature values; after n values with m matches, the posterior
   of the similarity under a uniform prior is Beta(m + 1, n - m + 1), and a pair goes as soon as the chance of
   reaching the threshold is below MISS.
4. Survivors are verified on their full sets, the best candidate of each node first. Pairs inside a component need no
   verification.
5. Buckets that still hold several components are compared member by member across components, in blocks, inside tasks:
   the bucket's largest component block by block against the others, and the others among themselves. Pairs whose set
   sizes exclude the similarity go first, then those outside the bound on signatures; the full sets of the documents that are left are
   compared last. A task gives one link for each two components it joins. So no pair of a bucket is dropped, and none is emitted for its own sake.

Links, classes and components stay distributed. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; with fewer than five
words the whole sequence is the one shingle.

Defined cases: texts that are null, empty or white space have an empty set, no link, and are their own component; rows
with a null doc_id take part in nothing (component null, kept true); rows that repeat a doc_id are one node
of the graph; an empty table gives an empty result; extra columns are not read by ``near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmesh.llm.common import discard, materialize, shuffle_partitions
from groundmesh.llm.graph import components

WORDS = 5
ROWS = 5
BANDS = 36
HASHES = ROWS * BANDS
FIRST_BANDS = 4
BATCH = 30
SIMILARITY = (75, 100)  # intersection over union, as a fraction
MISS = 1e-4
BLOCK = 256
STEP = 64
BROADCAST_IDS = 1_000_000
SIGNED = "doc_id long, n_shingles long, hi long, lo long, signature binary"

_rng = np.random.default_rng(11)
MULTIPLIERS = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
ADDENDS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
BASE = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's 5-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(WORDS, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for j in range(size):
            total = scramble(total * BASE + h[j : j + len(total)])
    return np.unique(total)


def signature(found: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 16 bits each."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        least = np.minimum(least, (x[at : at + 2048, None] * MULTIPLIERS + ADDENDS).min(axis=0))
    return (least & 0xFFFF).astype("<u2")


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's hash (hi, lo) and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo, signed = [], [], [], []
            with np.errstate(over="ignore"):
                for text in batch["text"]:
                    found = shingles(text.as_py())
                    n.append(len(found))
                    hi.append(int(scramble(found).sum(dtype=np.uint64).astype(np.int64)))
                    lo.append(int(np.bitwise_xor.reduce(scramble(found ^ BASE), initial=np.uint64(0)).astype(np.int64)))
                    signed.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(signed, pa.binary())], names=["doc_id", "n_shingles", "hi", "lo", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def least_matches(threshold: float = SIMILARITY[0] / SIMILARITY[1], miss: float = MISS) -> dict[int, int]:
    """After n compared values, the fewest matches whose posterior still reaches the threshold with chance ``miss``.

    P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m).
    """
    table = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        table[n] = m
    return table


def compare(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, table: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of signatures a against rows j of b, batch by batch: which pairs survive, and the matches of all."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), dtype=np.int32)
    for n in range(BATCH, HASHES + 1, BATCH):
        part = slice(n - BATCH, n)
        matches[alive] += (a[:, part][i[alive]] == b[:, part][j[alive]]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= table[n]]
        if not len(alive):
            break
    return alive, matches


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, HASHES)


def bayes(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (u, v) that pass every batch, with their matches."""
    table = least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                every = np.arange(batch.num_rows)
                alive, matches = compare(matrix(batch["su"]), every, matrix(batch["sv"]), every, table)
                yield pa.RecordBatch.from_arrays([batch["u"].take(pa.array(alive)), batch["v"].take(pa.array(alive)), pa.array(matches[alive])], names=["u", "v", "matches"])

    left = signatures.select(F.col("doc_id").alias("u"), F.col("signature").alias("su"))
    right = signatures.select(F.col("doc_id").alias("v"), F.col("signature").alias("sv"))
    return pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "su", "sv").mapInArrow(run, "u long, v long, matches int")


def full_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, found: the full shingle sets of the documents named. Only their texts are shuffled, and none while ids are few."""
    ids = materialize(ids, "ids")
    named = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()).tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sets, pa.binary())], names=["doc_id", "found"])

    sets = materialize(named.select("doc_id", "text").mapInArrow(gather, "doc_id long, found binary"), "sets")
    discard(ids)
    return sets


def verify(pairs: DataFrame, docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Pairs (u, v) whose full shingle sets reach the similarity, written."""
    pairs = materialize(pairs.select("u", "v").distinct(), "pairs")
    sets = full_sets(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), docs)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, below = similarity
        for batch in batches:
            keep = []
            for a, b in zip(batch["fu"], batch["fv"], strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(below * common >= above * (len(x) + len(y) - common) > 0)
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("found").alias("fu")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("found").alias("fv")), "v")
    links = materialize(both.select("u", "v", "fu", "fv").mapInArrow(check, "u long, v long"), "links")
    discard(pairs, sets)
    return links


def band_keys(signatures: DataFrame, bands: range) -> DataFrame:
    """doc_id, key: one row per band."""
    width = ROWS * 2
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("signature", b * width + 1, width)) for b in bands))
    return signatures.select("doc_id", F.explode(keys).alias("key"))


def stars(rows: DataFrame, node: str) -> DataFrame:
    """Pairs (u, v) of every bucket's leader with its other members: the smallest node in an order of the bucket's own."""
    mask = F.xxhash64("key", F.lit(17))
    leaders = rows.groupBy("key").agg(F.min(F.col(node).bitwiseXOR(mask)).alias("a"), F.max(F.col(node).bitwiseXOR(mask)).alias("b")).where("a <> b")
    members = rows.join(leaders.select("key", F.col("a").bitwiseXOR(mask).alias("leader")), "key").where(F.col(node) != F.col("leader"))
    return members.select(F.least(node, "leader").alias("u"), F.greatest(node, "leader").alias("v")).distinct()


def labelled(signatures: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, key, component of every band; a representative without link is its own component."""
    own = nodes.select(F.col("node").alias("doc_id"), "component")
    known = signatures.join(own, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    return band_keys(known, range(BANDS)).join(known.select("doc_id", "component"), "doc_id")


def grouped(rows: DataFrame, run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``run`` to whole (key, first, second) groups, a few at a time: rows are dealt and sorted by group, and a batch's
    last group waits for the next batch."""
    order = ["key", "first", "second"]

    def cuts(table: pa.Table) -> np.ndarray:
        keys = np.column_stack([table[c].to_numpy() for c in order])
        return np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            at = [0, *cuts(held).tolist()]
            for x, y in zip(at, at[1:], strict=False):
                yield from run(held.slice(x, y - x).combine_chunks())
            held = held.slice(at[-1])
        if held is not None and held.num_rows:
            yield from run(held.combine_chunks())

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(stream, schema)


def across(signatures: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Links (u, v) between components that share a bucket: every such pair of documents is compared, inside tasks.

    Members of a bucket's largest component are dealt into blocks, each one group (block, -1) with all other members; these are dealt
    into blocks too, and each pair of their blocks is one group. First the groups are run on signatures: documents without a pair that passes the
    Bayesian bound leave. Then the others' full sets are compared; of the links found, a group gives one per pair of components it joins, so no
    pair is emitted for its own sake.
    """
    rows = labelled(signatures, nodes)
    sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("components")).where("components > 1")
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    mixed = mixed.select("key", F.col("main.component").alias("main"), blocks(F.col("main.n")).alias("mains"), blocks(F.col("n") - F.col("main.n")).alias("others"))
    rows = rows.join(mixed, "key").join(signatures.select("doc_id", "n_shingles", "signature"), "doc_id")
    at = lambda n: F.pmod(F.xxhash64("doc_id", "key"), n).cast("int")
    of = lambda first, second, side: F.struct(first.alias("first"), second.alias("second"), side.alias("side"))
    is_main, alone = F.col("component") == F.col("main"), F.lit(-1)
    own = at(F.col("others"))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda b: of(b, alone, F.lit(True)))
    with_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda b: of(F.least(own, b), F.greatest(own, b), own > b))
    place = F.when(is_main, F.array(of(at(F.col("mains")), alone, F.lit(False)))).otherwise(F.concat(with_main, with_others))
    rows = rows.select("key", F.explode(place).alias("place"), "doc_id", "component", "n_shingles", "signature").select("key", "place.*", "doc_id", "component", "n_shingles", "signature")
    table, (above, below) = least_matches(), similarity
    kept = ["key", "first", "second", "side", "doc_id", "component"]

    def bounded(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, label, side, size = (group[c].to_numpy() for c in ("doc_id", "component", "side", "n_shingles"))
        if len(ids) < 2 or (label == label[0]).all():
            return
        crossing = group["first"][0].as_py() != group["second"][0].as_py()
        values, some = np.frombuffer(b"".join(group["signature"].to_pylist()), dtype="<u2").reshape(-1, HASHES), np.zeros(len(ids), dtype=bool)
        for at in range(0, len(ids), STEP):
            i, j = np.meshgrid(np.arange(at, min(at + STEP, len(ids))), np.arange(len(ids)), indexing="ij")
            wanted = (label[i] != label[j]) & (~side[i] & side[j] if crossing else ids[i] < ids[j])
            wanted &= below * np.minimum(size[i], size[j]) >= above * np.maximum(size[i], size[j])
            i, j = i[wanted], j[wanted]
            alive, _ = compare(values, i, values, j, table)
            some[i[alive]] = some[j[alive]] = True
        if some.any():
            yield from group.select(kept).filter(pa.array(some)).to_batches()

    def exact(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, label, side = group["doc_id"].to_numpy(), group["component"].to_numpy().copy(), group["side"].to_numpy()
        crossing = group["first"][0].as_py() != group["second"][0].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["found"]]
        sizes = np.array([len(x) for x in sets])
        every, begin = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out = []
        for i in range(len(ids)):
            others = np.flatnonzero((label != label[i]) & (~side[i] & side if crossing else ids > ids[i]))
            if not len(others):
                continue
            at = np.minimum(np.searchsorted(sets[i], every), sizes[i] - 1)
            common = np.add.reduceat((sets[i][at] == every).astype(np.int64), begin)[others]
            for j in others[below * common >= above * (sizes[i] + sizes[others] - common)]:
                if label[j] != label[i]:  # one link for each component that is met
                    out.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])

    passed = materialize(grouped(rows, bounded, "key long, first int, second int, side boolean, doc_id long, component long"), "across")
    sets = full_sets(passed.select("doc_id").distinct(), docs)
    links = materialize(grouped(passed.join(sets, "doc_id").select(*kept, "found"), exact, "u long, v long"), "links")
    discard(passed, sets)
    return links


def link(signed: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, nodes): hi, lo, n_shingles -> representative; representative -> component, where it has links."""
    real = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(real.groupBy("n_shingles", "hi", "lo").agg(F.min("doc_id").alias("rep")), "classes")
    same = (real["doc_id"] == classes["rep"]) & (real["hi"] == classes["hi"]) & (real["lo"] == classes["lo"])
    signatures = materialize(real.join(classes, same).select(real["doc_id"], real["hi"], real["n_shingles"], "signature").dropDuplicates(["doc_id", "hi"]).drop("hi"), "signatures")

    # a few bands give every node its first candidates; the best of each is verified first
    pairs = materialize(stars(band_keys(signatures, range(FIRST_BANDS)), "doc_id"), "candidates")
    passed = materialize(bayes(pairs, signatures), "passed")
    mark = lambda *by: F.col("matches").cast("long") * (1 << 20) + F.pmod(F.xxhash64(*by), F.lit(1 << 20))
    ends = passed.select(F.col("u").alias("node"), F.col("v").alias("to"), "matches").union(passed.select("v", "u", "matches")).withColumn("mark", mark("to"))
    first = ends.join(ends.groupBy("node").agg(F.max("mark").alias("mark")), ["node", "mark"]).select(F.least("node", "to").alias("u"), F.greatest("node", "to").alias("v"))
    tested = materialize(first.distinct(), "tested")
    links = verify(tested, docs)
    nodes = components(links)
    discard(pairs, passed)

    # all bands, one member of each component in a bucket
    mask = F.xxhash64("key", F.lit(17))
    members = labelled(signatures, nodes).groupBy("key", "component").agg(F.min(F.col("doc_id").bitwiseXOR(mask)).alias("m")).select("key", F.col("m").bitwiseXOR(mask).alias("doc_id"))
    pairs = materialize(stars(members, "doc_id").join(tested, ["u", "v"], "left_anti"), "candidates")
    passed = materialize(bayes(pairs, signatures).select("u", "v"), "passed")
    more = verify(passed, docs)
    discard(nodes, pairs, tested, passed)
    nodes = components(links.union(more))

    # last, members of a bucket that were not compared with each other
    last = across(signatures, nodes, docs)
    discard(nodes, signatures)
    nodes = components(links.union(more).union(last))
    discard(links, more, last)
    return classes, nodes


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(sign(rows), "signed")
    classes, nodes = link(signed, rows)
    of_class = classes.join(nodes, classes["rep"] == nodes["node"], "left").select("n_shingles", "hi", "lo", F.coalesce("component", "rep").alias("component_id"))
    joined = signed.select("doc_id", "n_shingles", "hi", "lo").join(of_class, ["n_shingles", "hi", "lo"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, stored: bool = False) -> DataFrame:
    """The rows of docs, all columns kept, of one document per component: that with the smallest doc_id.

    Rows are compared as rows, whatever their doc_id: those that repeat one go only if their texts are alike, and those
    without one take part and stay after those with one. Rows without words all stay. ``stored``: docs is a table as read from its files, so that the
    numbers of its rows are the same in every scan; without it docs is written first.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("at"))
    rows = rows if stored else materialize(rows, "rows")
    found = near_duplicates(rows.select(F.col("at").alias("doc_id"), F.col("row.text").alias("text"))).select(F.col("doc_id").alias("at"), "component_id")
    ids = rows.select("at", F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").cast("long").alias("id"), "at").alias("order"))
    decided = materialize(found.join(ids, "at"), "decided")
    discard(found)
    first = decided.groupBy("component_id").agg(F.min("order").alias("first"))
    gone = materialize(decided.join(first, "component_id").where("order <> first").select("at"), "gone")
    discard(decided)
    return rows.join(gone, "at", "left_anti").select(*(F.col("row")[c].alias(c) for c in docs.columns))
