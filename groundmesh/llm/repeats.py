"""Removal of every byte that a repeated string of WIDTH bytes covers: suffix arrays by two-stage sorting, over strings dealt by anchors.

1. Every place of a text where WIDTH bytes begin has an anchor: of the strings of ``LEVELS[0]`` bytes inside, the first with the smallest hash.
   Equal strings have equal anchors, so they meet wherever texts are dealt by the anchor's hash. Neighbouring places with
   equal anchors form one run; a run's segment is all that its strings cover.
2. Runs are counted by anchor. An anchor that occurs once repeats nothing. Equal segments are counted and one of each
   goes on; a segment that occurs twice is repeated as a whole.
3. The distinct segments of an anchor are sorted in one task, many anchors at a time, by a two-stage suffix array
   (see suffixarray); places whose neighbour in order shares WIDTH bytes are repeated. Common prefixes are compared byte by byte.
4. An anchor with over CELL distinct segments is dealt on: its segments are the texts of the next level, where anchors are
   longer. At the last level the anchor is the whole string of WIDTH bytes, and is counted only, by 128 bits of hash. So no group is
   sorted in one task because it is frequent, and none is left out.
5. Repeated spans are joined back to the texts, where they are united and cut out.

A text is known by its doc_id and a 64-bit hash, so any DataFrame will do. Sides are broadcast while they are at most BROADCAST_ROWS rows and
BROADCAST_BYTES; beyond, both sides are shuffled.

Defined cases: null texts are empty; texts under WIDTH bytes lose nothing; rows that repeat a text (their doc_id too) lose it
all from WIDTH bytes on, the first as well; a null doc_id is a document like others; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmesh.llm.common import discard, materialize, shuffle_partitions, small
from groundmesh.llm.suffixarray import repeated_places

WIDTH = 400
#: Bytes of an anchor at each level, as shares of the width; the last level's anchor is the whole string.
LEVELS = (0.32, 0.96, 1.0)
#: Distinct segments of one anchor that are sorted in one task.
CELL = 1024
#: Places of one segment, at most, and of one pass over a text.
SEGMENT = 1024
PASS_BITS = 20
#: Bytes that are sorted together, about.
BIN_BYTES = 1 << 20
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20
RUNS = "a long, b long, start int, size int, n long, w long, key long, seg long"
SEGMENTS = "key long, seg long, n long, text binary"
SPANS = "key long, seg long, lo int, hi int"
CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_base = 0x9E3779B97F4A7C15
_values = np.random.default_rng(12).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, count: int) -> np.ndarray:
    out, have = np.ones(count, dtype=np.uint64), 1
    while have < count:
        out[have : 2 * have] = out[: min(have, count - have)] * np.uint64(pow(base, have, 1 << 64))
        have *= 2
    return out


class Anchors:
    """The runs of a text, for one length of anchors."""

    def __init__(self, width: int, length: int) -> None:
        self.width, self.length = width, length
        self.up = powers(_base, (1 << PASS_BITS) + width)
        self.down = powers(pow(_base, -1, 1 << 64), (1 << PASS_BITS) + width)

    def hashes(self, raw: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the string of ``length`` bytes at every place."""
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_values[raw] * self.up[: len(raw)])])
        x = (sums[self.length :] - sums[: -self.length]) * self.down[: len(raw) - self.length + 1]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def runs(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """start, size, number of anchors and the anchor's hash of every run of a text, a pass at a time."""
        for at in range(0, len(raw) - self.width + 1, 1 << PASS_BITS):
            part = raw[at : at + (1 << PASS_BITS) + self.width - 1]
            h = self.hashes(part)
            mask = np.uint64((1 << PASS_BITS + 1) - 1)  # place in the pass: ties go to the first
            least, span, inside = (h & ~mask) | np.arange(len(h), dtype=np.uint64), 1, self.width - self.length + 1
            while span * 2 <= inside:
                least, span = np.minimum(least[:-span], least[span:]), span * 2
            if span < inside:
                least = np.minimum(least[: span - inside], least[inside - span :])
            place = (least & mask).astype(np.int64)
            anchors = np.flatnonzero(np.diff(place, prepend=-1))
            key = h[place[anchors]]
            run = np.concatenate([[True], key[1:] != key[:-1]])
            # a run is cut where it would be longer than SEGMENT places
            count = np.diff(np.append(np.flatnonzero(run), len(run)))
            start, key = anchors[run], key[run]
            places = np.diff(np.append(start, len(place)))
            pieces = -(-places // SEGMENT)
            piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, key, count, places = (np.repeat(x, pieces) for x in (start, key, count, places))
            yield at + start + piece * SEGMENT, np.minimum(places - piece * SEGMENT, SEGMENT) + self.width - 1, count, key


def find_runs(texts: DataFrame, width: int, level: int) -> DataFrame:
    """Texts (a, b, n copies, text) -> their runs: place, anchor (key), number of anchors w, hash of the segment."""
    length, last = round(width * LEVELS[level]), level == len(LEVELS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(width, length)
        for batch in small(batches):
            out: list[list[np.ndarray]] = []
            for number, text in enumerate(batch["text"]):
                whole = text.as_buffer()
                if len(whole) >= width:
                    whole = memoryview(whole)
                    for start, size, count, key in anchors.runs(np.frombuffer(whole, np.uint8)):
                        ends = start + (width if last else size)
                        seg = np.fromiter((xxhash.xxh3_64_intdigest(whole[i:j]) for i, j in zip(start.tolist(), ends.tolist(), strict=True)), np.uint64, len(start))
                        out.append([np.full(len(start), number), start, size, count, key, seg])
            if out:
                number, start, size, count, key, seg = map(np.concatenate, zip(*out, strict=True))
                copies = batch["n"].to_numpy()[number]
                take = pa.array(number)
                yield pa.RecordBatch.from_arrays(
                    [batch["a"].take(take), batch["b"].take(take), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(copies), pa.array(copies * count), pa.array(key.view(np.int64)), pa.array(seg.view(np.int64))],
                    names=["a", "b", "start", "size", "n", "w", "key", "seg"],
                )

    return texts.select("a", "b", "n", "text").mapInArrow(run, RUNS)


def within(df: DataFrame, rows: int, row_bytes: int = 0) -> DataFrame:
    """df, to be broadcast if its size, which was counted, is within the limits."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * row_bytes <= BROADCAST_BYTES else df


def cut_segments(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted segments (a, b, start, size, key, seg, n): they go to their texts, or both meet in a shuffle.

    Rows that repeat a doc_id and a text give their segments once each.
    """
    per_text = materialize(wanted.groupBy("a", "b").agg(F.collect_list(F.struct("start", "size", "key", "seg", "n")).alias("parts")), "wanted")
    sizes = per_text.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("parts")), F.lit(0)).alias("parts")).first()
    met = texts.select("a", "b", "text").join(within(per_text, sizes["rows"], 40 * sizes["parts"] // max(1, sizes["rows"])), ["a", "b"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for text, parts in zip(batch["text"], batch["parts"], strict=True):
                whole, parts = memoryview(text.as_buffer()), parts.as_py()
                pieces = [bytes(whole[p["start"] : p["start"] + p["size"]]) for p in parts]
                yield pa.RecordBatch.from_pydict({"key": [p["key"] for p in parts], "seg": [p["seg"] for p in parts], "n": [p["n"] for p in parts], "text": pieces}, schema=schema)

    schema = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("n", pa.int64()), ("text", pa.binary())])
    return materialize(met.select("text", "parts").mapInArrow(cut, SEGMENTS), "segments")


def sort_bins(segments: DataFrame, width: int) -> DataFrame:
    """Repeated spans of the segments: those of a key in one task, as many keys as make up a bin sorted together."""

    def spans(bin_: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        strings = [s for _, _, s in bin_]
        found, begin = repeated_places(strings, width)
        number = np.searchsorted(begin, found, side="right") - 1
        first = np.concatenate([[True], (number[1:] != number[:-1]) | (np.diff(found) > width)]) if len(found) else np.zeros(0, dtype=bool)
        starts = np.flatnonzero(first)
        lasts = np.append(starts[1:], len(found))[: len(starts)] - 1
        number = number[starts]
        lo, hi = found[starts] - begin[number], found[lasts] - begin[number] + width
        keys, segs = (np.fromiter((x[i] for x in bin_), np.int64, len(bin_))[number] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(segs), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["key", "seg", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for key, seg, text in zip(batch["key"].to_pylist(), batch["seg"].to_pylist(), batch["text"], strict=True):
                if held and (key, seg) == held[-1][:2]:
                    continue
                if size >= BIN_BYTES and key != held[-1][0]:
                    yield spans(held)
                    held, size = [], 0
                held.append((key, seg, text.as_py()))
                size += len(held[-1][2])
        if held:
            yield spans(held)

    dealt = segments.select("key", "seg", "text").repartition(max(shuffle_partitions(segments.sparkSession), 1), "key").sortWithinPartitions("key", "seg")
    return dealt.mapInArrow(run, SPANS)


def repeated_spans(texts: DataFrame, width: int = WIDTH, cell: int = CELL, level: int = 0) -> DataFrame:
    """a, b, lo, hi: byte spans of the texts (a, b, n copies, text) that are covered by repeated strings of ``width`` bytes; they may overlap."""
    runs = materialize(find_runs(texts, width, level), "runs")
    if level == len(LEVELS) - 1:
        counted = runs.groupBy("key", "seg").agg(F.sum("w").alias("w")).where("w > 1").select("key", "seg")
        found = materialize(counted, "repeated")
        return runs.join(within(found, found.count(), 16), ["key", "seg"]).select("a", "b", F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi"))
    often = materialize(runs.groupBy("key").agg(F.sum("w").alias("w")).where("w > 1").select("key"), "anchors")
    rows = often.count()
    met = runs.join(within(often, rows, 8), "key")
    if rows > BROADCAST_ROWS:
        met = met.repartition("key", "seg")  # so that the join may split a frequent key
    one = F.min(F.struct("a", "b", "start", "size")).alias("one")
    distinct = materialize(met.groupBy("key", "seg").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), one), "distinct")
    kinds = materialize(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")), "kinds")
    # an anchor with one segment: its count decides, unless the segment itself holds the anchor twice
    wanted = materialize(distinct.join(within(kinds, rows, 16), "key").where("kinds > 1 OR (n = 1 AND w > 1)").select("key", "seg", "n", "kinds", "one.*"), "wanted")
    segments = cut_segments(texts, wanted)
    hot = materialize(wanted.where(F.col("kinds") > cell).select("key").distinct(), "hot")
    hot_keys = hot.count()
    cold = segments.join(within(hot, hot_keys, 8), "key", "left_anti") if hot_keys else segments
    found = sort_bins(cold, width)
    if hot_keys:
        deeper = segments.join(within(hot, hot_keys, 8), "key", "left_semi").select(F.col("key").alias("a"), F.col("seg").alias("b"), "n", "text").dropDuplicates(["a", "b"])
        found = found.union(repeated_spans(deeper, width, cell, level + 1).select(F.col("a").alias("key"), F.col("b").alias("seg"), "lo", "hi"))
    whole = distinct.where("n > 1").select("key", "seg", F.lit(0).alias("lo"), F.col("one.size").alias("hi"))
    spans = materialize(found.join(whole.select("key", "seg"), ["key", "seg"], "left_anti").union(whole), "found")
    discard(wanted, segments, often, kinds, hot)
    return runs.join(within(spans, spans.count(), 24), ["key", "seg"]).select("a", "b", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))


def known_texts(docs: DataFrame) -> DataFrame:
    """doc_id, the two numbers that a text is known by, its bytes."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("a"), F.xxhash64(raw).alias("b"), F.lit(1).cast("long").alias("n"), raw.alias("text"))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans, which don't touch, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def without_repeats(docs: DataFrame, width: int = WIDTH, cell: int = CELL) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document: what is left once repeated bytes are gone."""
    texts = known_texts(docs)
    spans = repeated_spans(texts, width, cell).groupBy("a", "b").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = materialize(spans, "spans")
    sizes = spans.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")).first()
    met = texts.join(within(spans, sizes["rows"], 16 + 16 * sizes["spans"] // max(1, sizes["rows"])), ["a", "b"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, found in zip(batch["text"], batch["spans"], strict=True):
                whole, at, digest = memoryview(text.as_buffer()), 0, hashlib.sha256()
                gone = united([(s["lo"], s["hi"]) for s in found.as_py() or ()])
                for lo, hi in gone:
                    digest.update(whole[at:lo])
                    at = hi
                digest.update(whole[at:])
                n_bytes.append(len(whole))
                n_removed.append(sum(hi - lo for lo, hi in gone))
                n_spans.append(len(gone))
                kept.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return met.select("doc_id", "text", "spans").mapInArrow(cut, CUT)
