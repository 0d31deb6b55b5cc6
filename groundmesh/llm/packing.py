"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

Only lengths decide which pieces share a sequence, and there are at most ``capacity`` of them. So the plan is made
from the histogram (at most 2,048 rows whatever the corpus): per bin, a bitset subset-sum over the lengths still
available finds the fullest combination with the largest one; it is removed as often as the counts allow. The plan
is a table of rank intervals per length; its size is bounded by the capacity, not by the corpus. Spark numbers the
pieces of every length (salted, no length in one task) and looks each number up in the plan.

In order (``in_order``), sequences follow the rows of the Parquet files that docs were read from: the n-th of a plan
row's T bins is meant for (n + 1/2) / T of the input, pieces of a length take the places of that length in the order of
the input, and sequences are numbered by the mean place of their tokens in it. How full they are does not change.

Defined cases: a null text is an empty one, and an empty document is the end token alone; a repeated row is packed
again; a null doc_id is carried; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmesh.llm.common import NUMBERING_CELL_ROWS, discard, materialize, number_in_order, number_within
from groundmesh.llm.tokens import load_encoder

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACE = "_file string, _row long"


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths whose sum is the largest not above room, larger lengths first."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in available if x <= room), reverse=True):
        left, part = min(available[length], room // length), 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how often, lengths with their multiplicity), every piece of the histogram in exactly one bin.

    Each step fills one bin and uses up at least one length to below its multiplicity in the bin, so the number of
    steps depends on the capacity alone.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    bins = []
    while left:
        largest = max(left)
        rest = left | {largest: left[largest] - 1}
        chosen = fullest({k: v for k, v in rest.items() if v}, capacity - largest)
        chosen[largest] = chosen.get(largest, 0) + 1
        times = min(left[k] // m for k, m in chosen.items())
        bins.append((times, chosen))
        for k, m in chosen.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
    return bins


def plan_table(bins: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Rank intervals: pieces of ``length`` numbered from ``first`` on go ``many`` to a bin, from ``base`` and ``offset`` on."""
    rows, used, base = [], {}, 0
    for times, chosen in bins:
        offset = 0
        for length in sorted(chosen, reverse=True):
            many = chosen[length]
            first = used.get(length, 0)
            rows.append((length, first, base, many, offset))
            used[length] = first + many * times
            offset += length * many
        base += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("length", "first", "base", "many", "offset"))}


def token_pieces(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]], capacity: int = CAPACITY, end_id: int = 0, in_order: bool = False) -> DataFrame:
    """Token ids and the end id per document, cut only where longer than the capacity; one pass, whole texts.

    in_order: add the file and row that docs, as read from Parquet, have each document from.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, texts = part["doc_id"].to_pylist(), [x or "" for x in part["text"].to_pylist()]
                places = zip(part["_file"].to_pylist(), part["_row"].to_pylist(), strict=True) if in_order else [()] * len(ids)
                rows = []
                for doc_id, place, tokens in zip(ids, places, encode(texts), strict=True):
                    stream = np.append(tokens, end_id).astype("<u4")
                    rows += [(doc_id, n, s, min(capacity, len(stream) - s), zlib.crc32(stream[s : s + capacity].tobytes()), *place) for n, s in enumerate(range(0, len(stream), capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if in_order:
        schema = schema.append(pa.field("_file", pa.string())).append(pa.field("_row", pa.int64()))
        read = docs.metadataColumn("_metadata")
        columns += [read["file_name"].alias("_file"), read["row_index"].alias("_row")]
    return docs.select(*columns).mapInArrow(cut, f"{PIECES}, {PLACE}" if in_order else PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` of 1 to capacity."""
    pieces = materialize(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    table = plan_table(minimum_bin_slack(histogram, capacity))
    shift = np.int64(1) << np.int64(40)
    keys = table["length"] * shift + table["first"]
    total = sum(histogram.values())
    numbered = number_within(pieces, ["length"], F.struct("doc_id", "piece"), [F.col("doc_id"), F.col("piece")], total, "_rank")
    columns = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            step = rank - table["first"][at]
            out = [batch[c] for c in columns]
            out += [pa.array(table["base"][at] + step // table["many"][at]), pa.array(table["offset"][at] + step % table["many"][at] * length)]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, "sequence_id", "offset"])

    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(place, f"{spec}, sequence_id long, offset long")


def pack_in_order(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces with _file and _row, which go: sequences in the order of files and rows."""
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if c not in ("_file", "_row")]
    pieces = materialize(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    rows, base = [], 0  # a row for each way of filling a sequence
    for times, chosen in minimum_bin_slack(histogram, capacity):
        rows.append((base, times, [(length, many) for length, many in sorted(chosen.items(), reverse=True)]))
        base += times
    plan = spark.createDataFrame(rows, "base long, times long, steps array<struct<length:long,many:long>>")
    zero, cells = F.lit(0).cast("long"), F.lit(NUMBERING_CELL_ROWS).cast("long")
    plan = plan.select("*", F.explode(F.sequence(zero, F.floor((F.col("times") - 1) / cells))).alias("part")).repartition("base", "part")
    nth = F.explode(F.sequence(F.col("part") * cells, F.least((F.col("part") + 1) * cells, F.col("times")) - 1))
    bins = plan.select("base", "times", "steps", nth.alias("nth"))
    bins = bins.select((F.col("base") + F.col("nth")).alias("bin"), ((F.col("nth") + 0.5) / F.col("times")).alias("at"), "steps")

    # places of all pieces, as many as pieces, numbered inside each length
    before = F.aggregate(F.slice("steps", 1, F.col("step")), F.lit(0).cast("long"), lambda a, x: a + x["length"] * x["many"])
    steps = bins.select("bin", "at", "steps", F.posexplode("steps").alias("step", "one")).withColumn("begin", before)
    places = steps.select("bin", "at", "begin", F.col("one.length").alias("length"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("one.many") - 1)).alias("turn"))
    places = places.select("length", "bin", "at", (F.col("begin") + F.col("turn") * F.col("length")).alias("offset"))
    parts = max(1, sum(histogram.values()) // NUMBERING_CELL_ROWS * 4)
    places = number_in_order(places, ["length"], F.floor(F.col("at") * parts), [F.col("at"), F.col("bin"), F.col("offset")], "_rank").drop("at")

    file = F.struct(F.length("_file").alias("n"), F.col("_file").alias("name"))  # part-100000 comes after part-99999
    cell = F.struct(file.alias("file"), F.floor(F.col("_row") / NUMBERING_CELL_ROWS).alias("rows"))
    all_ = F.lit(0).alias("_all")
    numbered = number_in_order(pieces.select("*", all_), ["_all"], cell, [F.col("_row"), F.col("piece")], "_position", F.col("_cell.file"))
    positions = materialize(numbered, "positions")
    numbered = number_in_order(positions, ["length"], F.floor(F.col("_position") / NUMBERING_CELL_ROWS), [F.col("_position")], "_rank")
    placed = materialize(numbered.join(places, ["length", "_rank"]), "placed")
    discard(pieces, positions)
    mean = placed.groupBy("bin").agg((F.sum(F.col("_position") * F.col("length")) / F.sum("length")).alias("mean"))
    sequences = number_in_order(mean.select("*", all_), ["_all"], F.floor(F.col("mean") / NUMBERING_CELL_ROWS), [F.col("mean"), F.col("bin")], "sequence_id")
    return placed.join(sequences.select("bin", "sequence_id"), "bin").select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, in_order: bool = False) -> DataFrame:
    """Pack the whole texts of documents into sequences of at most ``capacity`` tokens.

    in_order: docs must be as read from Parquet; sequences follow the order of their files and rows.
    """
    if in_order:
        try:
            docs.select(docs.metadataColumn("_metadata")["row_index"]).schema
        except AnalysisException as e:
            raise ValueError("in_order takes documents as read from Parquet, whose files and rows have an order") from e
        return pack_in_order(token_pieces(docs, load_encoder(tokenizer_path), capacity, end_id, True), capacity)
    return pack(token_pieces(docs, load_encoder(tokenizer_path), capacity, end_id), capacity)
