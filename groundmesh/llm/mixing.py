"""Mixing sources to target weights by Pfair scheduling of blocks of documents.

A source of weight w (its share of the weights, an exact fraction) has block j released at floor(j / w) and due at
ceil((j + 1) / w), in slots of one block each. In every slot, of the blocks released the one with the earliest deadline
goes first. The weights sum to 1, so no deadline is missed and before every slot each source is less than one block away from
its weight, for as long as the phase lasts. When a source runs out, a new phase starts with the weights of the others.

The schedule is made on the driver over blocks of ``block_docs`` documents, whatever the size of the table: slot after slot, with one entry
a source as its only state, and written to the shared folder in slices of SLICE_SLOTS slots. So the driver holds one slice and the
sources (time: blocks times the log of the sources, and once the number of sources a phase). Documents are numbered in
Spark in salted cells, so a source that holds a third of all rows is never in one task, and look up their block: the
schedule is broadcast while it has at most BROADCAST_SLOTS rows; beyond, it is joined by source and block.

Defined cases: every row is kept; null sources form one source of their own; a null or repeated doc_id is numbered
as any row; sources without a given weight share what the given ones leave (or weigh as the smallest given); an empty
table gives an empty result; extra columns pass through, and the added names are free to choose by prefix; texts are not read.
"""

from __future__ import annotations

import heapq
import uuid
from array import array
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundmesh.llm.common import checkpoint_folder, number_within, shuffle_partitions

SLICE_SLOTS = 500_000
BROADCAST_SLOTS = 500_000
BLOCK_DOCS = 16
TEMPERATURE = 0.5
NO_SOURCE = "\x00"


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The same weights as whole numbers, exactly."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    scale = lcm(*(x.denominator for x in exact.values()))
    return {k: int(x * scale) for k, x in exact.items()}


def pfair(weights: dict[str, int]) -> Iterator[tuple[str, int, int, int]]:
    """(source, block, release, deadline) of slot 0, 1, ...: earliest deadline first among the released blocks."""
    total = sum(weights.values())
    window = lambda k, j: (j * total // weights[k], -(-(j + 1) * total // weights[k]))
    waiting = [(0, window(k, 0)[1], k, 0) for k in sorted(weights)]
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            release, deadline, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, k, j, release))
        deadline, k, j, release = heapq.heappop(ready)
        yield k, j, release, deadline
        heapq.heappush(waiting, (*window(k, j + 1), k, j + 1))
        slot += 1


def plan(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[int, str, int, int, int, int]]:
    """(phase, source, block, slot, release, deadline) of every block by slot; release and deadline count from slot 0 of all."""
    left, used = {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0)
    whole = whole_weights({k: weights[k] for k in left}) if left else {}
    phase = slot = 0
    while left:
        base, begin = slot, {k: used[k] for k in left}
        for k, j, release, deadline in pfair({k: whole[k] for k in left}):
            yield phase, k, begin[k] + j, slot, base + release, base + deadline
            slot += 1
            used[k] += 1
            if used[k] == blocks[k]:
                del left[k]
                break
        phase += 1


def write_schedule(spark: SparkSession, counts: dict[str, int], weights: dict[str, float], block_docs: int, slice_slots: int) -> tuple[DataFrame, int]:
    """The plan and the position of every block's first document as a table of the shared folder, and its number of rows."""
    path = f"{checkpoint_folder(spark)}/groundmesh/schedule-{uuid.uuid4().hex}"
    names = sorted(counts)
    code = {k: n for n, k in enumerate(names)}
    slots = plan({k: -(-n // block_docs) for k, n in counts.items()}, weights)
    position = rows = 0
    while True:
        source, numbers = array("i"), [array("q") for _ in range(6)]
        for phase, k, block, slot, release, deadline in islice(slots, slice_slots):
            source.append(code[k])
            for column, value in zip(numbers, (phase, block, slot, release, deadline, position), strict=True):
                column.append(value)
            position += min(block_docs, counts[k] - block * block_docs)  # a source's last block may be short
        if rows and not source:
            break
        columns = [pa.array(names, pa.string()).take(pa.array(source, pa.int32())), *(pa.array(c, pa.int64()) for c in numbers)]
        table = pa.table(columns, names=["p_source", "phase", "p_block", "slot", "release", "deadline", "p_start"])
        slice_ = spark.createDataFrame(table).withColumn("phase", F.col("phase").cast("int"))
        slice_.coalesce(1).write.mode("append").parquet(path)
        rows += len(source)
        if len(source) < slice_slots:
            break
    return spark.read.schema(slice_.schema).parquet(path), rows


def tempered(counts: dict[str, int], temperature: float) -> dict[str, float]:
    return {k: float(n) ** temperature for k, n in counts.items() if n}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", block_docs: int = BLOCK_DOCS, temperature: float = TEMPERATURE, prefix: str = "mix_", slice_slots: int = SLICE_SLOTS) -> DataFrame:
    """Add prefix + (source, phase, block, slot, release, deadline, position) to every row; positions are gapless from 0.

    weights: target weight by source; where None, each source weighs its row count to the power ``temperature``.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))
    counts = {r["s"]: r["n"] for r in docs.groupBy(source.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a source
    chosen = tempered(counts, temperature)
    if weights is not None:
        given = {k: float(v) for k, v in weights.items() if k in counts and v > 0}
        others = [k for k in counts if k not in given]
        each = max((1 - sum(given.values())) / max(1, len(others)), 0) or min(given.values(), default=1.0)
        chosen = given | dict.fromkeys(others, each)
    table, slots = write_schedule(spark, counts, chosen, block_docs, slice_slots)
    table = table.select(*(F.col(c).alias(c if c.startswith("p_") else f"{prefix}{c}") for c in table.columns))

    key, block = f"{prefix}source", f"{prefix}block"
    rows = docs.select(F.struct(*docs.columns).alias(f"{prefix}row"), source.alias(key), F.col(id_col).alias(f"{prefix}id"))
    numbered = number_within(rows, [key], F.col(f"{prefix}id"), [F.col(f"{prefix}id")], sum(counts.values()), f"{prefix}number")
    numbered = numbered.withColumn(block, F.floor(F.col(f"{prefix}number") / block_docs).cast("long"))
    placed = numbered.join(F.broadcast(table) if slots <= BROADCAST_SLOTS else table, (F.col(key) == F.col("p_source")) & (F.col(block) == F.col("p_block")))
    placed = placed.withColumn(f"{prefix}position", F.col("p_start") + F.col(f"{prefix}number") - F.col(block) * block_docs)
    added = [f"{prefix}{c}" for c in ("source", "phase", "block", "slot", "release", "deadline", "position")]
    return placed.select(*(F.col(f"{prefix}row")[c].alias(c) for c in docs.columns), *added)


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs, their columns only, in the order of the mix: ranges of positions by partition, sorted inside."""
    prefix = "mix_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    mixed = mix(docs, weights, prefix=prefix)
    at = f"{prefix}position"
    return mixed.repartitionByRange(shuffle_partitions(docs.sparkSession), at).sortWithinPartitions(at).select(*docs.columns)
