"""Language-model scoring by a probabilistic suffix tree over words.

Symbols are the distinct training words, the text's end, and one symbol for every unknown word. Contexts are the last
1 to DEPTH words before a token, the text's begin among them (nothing lies before it). The root discounts every count by a
Good-Turing estimate D = n1 / (n1 + 2 n2) and leaves the discounted mass to the unknown word. A context of any words is a
state when its next-symbol distribution, each training token left out in turn, diverges from that of its longest retained
suffix (its parent; the root if there is none) by at least DIVERGENCE nats in sum. A state's next symbols have counts
discounted by DISCOUNT, the rest of the mass going to the parent's distribution; a token is scored in the longest state
that is a suffix of what comes before it, else at the root.

No word and no context is left out by a limit. Texts are coded once, in blocks, by the places of their words in the block's
own list; the lists are counted and numbered in hash ranges, by falling count, so a word's number tells its count (broadcast: one
row per distinct count, at most the root of twice the tokens). Tokens are then dealt by the word before them into slices of
about SLICE_TOKENS, so that a task finds all contexts that end in a word together. A context that alone would fill a
slice is hot: its tokens are dealt on by the word before, and again, a hot context of DEPTH words by document; the counts
of its next symbols are added up in Spark and sent to each of its slices. Where tokens are dealt to does not change a score.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, known by 64-bit hashes. The base model's probability of a token is
(c + 1) / (N + V + 1).

Defined cases: null and empty texts are the end alone; a null doc_id counts as a training row; repeated rows count and
are scored again; without training rows every token is the unknown word with probability 1 (score 0); an empty table
gives an empty result; extra columns are not read; very long texts are coded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmesh.llm.common import discard, materialize, shuffle_partitions

DEPTH = 3
DIVERGENCE = 3.0
DISCOUNT = 0.75
HELD_OUT = (7, 2)
BLOCK_TOKENS = 1_000_000
#: A document is known by its partition, its block there (10**12 tokens fill as many) and its row in the block: 63 bits together.
TASK_BITS, PART_BITS, ROW_BITS = 23, 20, 20
#: Slices whose counts of one word frequency are added up in one task.
RUN_SLICES = 256
SLICE_TOKENS = 500_000
#: Sums per document that a task gathers before it sends them on.
SENT_SUMS = 1_000_000
END = np.int64(xxhash.xxh64_intdigest(b"\x00end of text") - (1 << 63))
MIX = np.uint64(0x9E3779B97F4A7C15)
CODED = "block long, tokens binary, sizes array<int>, ids array<long>, held array<boolean>"
PARTS = "slice int, level int, block long, symbols binary, rows binary, c1 long, c2 long, c3 long"


def scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chained(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The key of a context one symbol longer (or of a context and its next symbol)."""
    with np.errstate(over="ignore"):
        return scramble(key * MIX + symbol.astype(np.uint64) + np.uint64(1))


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers from 0, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:, :width].T).tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words and the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    out = (out ^ np.uint64(1 << 63)).view(np.int64)
    out[-1] = END
    return out


def code_texts(docs: DataFrame) -> DataFrame:
    """block, words and their training counts, tokens as places in words, and the documents of the block."""
    schema = pa.schema([("block", pa.int64()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("tokens", pa.binary()), ("sizes", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << PART_BITS
        if block >> PART_BITS + TASK_BITS:
            raise ValueError(f"an input of more than {1 << TASK_BITS} partitions: coalesce it first")
        ids: list = []
        held: list[bool] = []
        found: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(f) for f in found])
            words, places = np.unique(np.concatenate(found), return_inverse=True)
            train = np.repeat(~np.array(held, dtype=bool), sizes)
            counts = np.bincount(places[train], minlength=len(words))
            row = (block, words, counts, squeezed(places), sizes, ids, held)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

        size = 0
        for batch in batches:
            for doc_id, out, text in zip(batch["doc_id"], batch["held_out"], batch["text"], strict=True):
                ids.append(doc_id.as_py())
                held.append(out.as_py())
                found.append(word_hashes(text.as_py()))
                size += len(found[-1])
                if size >= BLOCK_TOKENS or len(ids) == 1 << ROW_BITS:
                    yield flush()
                    ids, held, found, size = [], [], [], 0
                    block += 1
        if ids:
            yield flush()

    spec = "block long, words array<long>, counts array<long>, tokens binary, sizes array<int>, ids array<long>, held array<boolean>"
    return docs.mapInArrow(run, spec)


@dataclass(frozen=True)
class Vocabulary:
    """Words are numbered by falling count: ``first`` number and ``count`` of each run of equal counts."""

    first: np.ndarray
    count: np.ndarray
    tokens: int
    distinct: int
    discount: float

    @property
    def begin(self) -> int:
        return self.distinct

    @property
    def unknown(self) -> int:
        return self.distinct + 1

    def counts(self, word: np.ndarray) -> np.ndarray:
        """Training counts; 0 for the unknown word."""
        if not len(self.first):
            return np.zeros(len(word), dtype=np.int64)
        return np.where(word < self.distinct, self.count[np.searchsorted(self.first, word, side="right") - 1], 0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.distinct + 1))

    def root(self, c: np.ndarray) -> np.ndarray:
        """Root probability of a word seen c times; 0 times: the unknown word."""
        n = max(1, self.tokens)
        unknown = self.discount * self.distinct / n if self.tokens else 1.0
        return np.where(c > 0, (c - self.discount) / n, unknown)


def merge_words(blocks: DataFrame, slices: int) -> DataFrame:
    """slice, counts of the distinct words of a range of hashes, and for each block where its words of the range stand among them."""
    width = (1 << 64) // slices + 1
    bounds = np.array([n * width - (1 << 63) for n in range(1, slices)], dtype=np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("slice", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for block, words, counts in zip(batch["block"], batch["words"], batch["counts"], strict=True):
                words, counts = words.values.to_numpy(), counts.values.to_numpy()
                cuts = np.searchsorted(words, bounds)  # a block's words are in order
                at = np.concatenate([[0], cuts, [len(words)]])
                some = np.flatnonzero(np.diff(at))
                parts = [slice(at[n], at[n + 1]) for n in some]
                columns = (some, [block.as_py()] * len(some), [words[x].tobytes() for x in parts], [squeezed(counts[x]) for x in parts])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("slice", pa.int32()), ("counts", pa.list_(pa.int64())), ("blocks", pa.list_(pa.int64())), ("places", pa.list_(pa.binary()))])
        now, held = None, []

        def merged() -> pa.RecordBatch:
            words = [np.frombuffer(w, np.int64) for _, w, _ in held]
            distinct, place = np.unique(np.concatenate(words), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([unsqueezed(c) for *_, c in held]), minlength=len(distinct)).astype(np.int64)
            places = [squeezed(x) for x in np.split(place, np.cumsum([len(w) for w in words])[:-1])]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now, counts, [b for b, *_ in held], places), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for n, *row in zip(*(batch[c].to_pylist() for c in ("slice", "block", "words", "counts")), strict=True):
                if n != now and held:
                    yield merged()
                    held = []
                now = n
                held.append(row)
        if held:
            yield merged()

    partitions = shuffle_partitions(blocks.sparkSession)
    sent = blocks.select("block", "words", "counts").mapInArrow(send, "slice int, block long, words binary, counts binary")
    dealt = sent.repartitionById(partitions, F.col("slice") % partitions).sortWithinPartitions("slice")
    return dealt.mapInArrow(merge, "slice int, counts array<long>, blocks array<long>, places array<binary>")


def number_words(blocks: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """(coded blocks, vocabulary): tokens as word numbers. Words are dealt by hash as packed lists, as many slices as blocks."""
    spark = blocks.sparkSession
    partitions = shuffle_partitions(spark)
    merged = materialize(merge_words(blocks, max(2 * partitions, blocks.count())), "words")
    of_count = merged.select("slice", F.explode("counts").alias("c")).where("c > 0").groupBy("slice", "c").agg(F.count(F.lit(1)).alias("n"))
    of_count = materialize(of_count, "counts")
    runs = sorted(((r["c"], r["n"]) for r in of_count.groupBy("c").agg(F.sum("n").alias("n")).collect()), reverse=True)  # a row per distinct count
    count, words = (np.array([r[i] for r in runs], dtype=np.int64) for i in (0, 1))
    first, distinct = np.cumsum(words) - words, int(words.sum())
    n1, n2 = (int(words[count == k].sum()) for k in (1, 2))
    discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.05
    v = Vocabulary(first, count, int((count * words).sum()), distinct, discount)
    # words of a count in earlier slices: in earlier runs of slices, and earlier in the run, so that no task has all slices of a count
    sums = lambda order, *of: F.coalesce(F.sum("n").over(W.partitionBy(*of).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    in_runs = of_count.withColumn("run", F.floor(F.col("slice") / RUN_SLICES))
    of_run = in_runs.groupBy("c", "run").agg(F.sum("n").alias("n")).select("c", "run", sums("run", "c").alias("base"))
    placed = in_runs.withColumn("inside", sums("slice", "c", "run")).join(of_run, ["c", "run"])
    offsets = placed.select("slice", F.struct("c", (F.col("base") + F.col("inside")).alias("earlier")).alias("o")).groupBy("slice").agg(F.collect_list("o").alias("o"))  # no more than the slice has words
    shared = spark.sparkContext.broadcast(v)

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for n, c, blocks_, places, known, earlier in zip(*(batch[x] for x in ("slice", "counts", "blocks", "places", "c", "earlier")), strict=True):
                c = c.values.to_numpy()
                number = np.full(len(c), v.unknown)
                if known.is_valid and len(known):
                    known, earlier = known.values.to_numpy(), earlier.values.to_numpy()
                    order = np.argsort(known)
                    at = np.flatnonzero(c > 0)
                    turn = np.argsort(c[at], kind="stable")  # words of one count, by hash
                    new = np.concatenate([[True], np.diff(c[at][turn]) != 0])
                    nth = np.empty(len(at), dtype=np.int64)
                    nth[turn] = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                    start = v.first[len(v.count) - 1 - np.searchsorted(v.count[::-1], c[at])]
                    number[at] = start + earlier[order][np.searchsorted(known[order], c[at])] + nth
                data = [squeezed(number[unsqueezed(p.as_py())]) for p in places]
                yield pa.RecordBatch.from_arrays([blocks_.values, pa.array([n.as_py()] * len(data), pa.int32()), pa.array(data, pa.binary())], names=["block", "slice", "numbers"])

    sent = merged.join(offsets, "slice", "left").select("slice", "counts", "blocks", "places", "o.c", "o.earlier").mapInArrow(reply, "block long, slice int, numbers binary")
    numbers = sent.withColumns({c: F.lit(None).cast(t) for c, t in (("tokens", "binary"), ("sizes", "array<int>"), ("ids", "array<long>"), ("held", "array<boolean>"))})
    both = numbers.unionByName(blocks.select("block", F.lit(-1).alias("slice"), F.lit(None).cast("binary").alias("numbers"), "tokens", "sizes", "ids", "held"))

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        kept = ("sizes", "ids", "held")

        def coded() -> pa.RecordBatch:
            table = np.concatenate([unsqueezed(x) for x in held])
            return pa.RecordBatch.from_arrays([now["block"], pa.array([squeezed(table[unsqueezed(now["tokens"][0].as_py())])], pa.binary()), *(now[c] for c in kept)], names=["block", "tokens", *kept])

        for batch in batches:
            for n, place in enumerate(batch["slice"].to_pylist()):
                if place < 0:
                    if held:
                        yield coded()
                    now, held = batch.slice(n, 1), []
                else:
                    held.append(batch["numbers"][n].as_py())
        if held:
            yield coded()

    dealt = both.repartition(partitions, "block").sortWithinPartitions("block", "slice")
    coded = materialize(dealt.mapInArrow(recode, CODED), "coded")
    discard(merged)
    discard(of_count)
    return coded, v


@dataclass(frozen=True)
class Block:
    """Tokens of a coded block with the words before them, nearest first."""

    number: int
    word: np.ndarray
    before: list[np.ndarray]
    row: np.ndarray
    train: np.ndarray

    def key(self, at: np.ndarray, level: int) -> np.ndarray:
        """Keys of the contexts of level + 1 words before the tokens at ``at``."""
        key = np.zeros(len(at), dtype=np.uint64)
        for symbols in self.before[: level + 1]:
            key = chained(key, symbols[at])
        return key


def coded_blocks(batches: Iterator[pa.RecordBatch], v: Vocabulary, depth: int) -> Iterator[Block]:
    for batch in batches:
        for number, data, sizes, held in zip(batch["block"], batch["tokens"], batch["sizes"], batch["held"], strict=True):
            word, sizes, held = unsqueezed(data.as_py()), sizes.values.to_numpy(), np.array(held.as_py(), dtype=bool)
            row = np.repeat(np.arange(len(sizes)), sizes)
            nth = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            before = []
            for k in range(1, depth + 1):
                symbols = np.full(len(word), v.begin)
                symbols[k:] = np.where(nth[k:] >= k, word[:-k], v.begin)
                before.append(symbols)
            yield Block(number.as_py(), word, before, row, ~held[row])


@dataclass(frozen=True)
class Hot:
    """Contexts that fill a slice or more: by length, sorted keys and over how many slices their tokens are dealt."""

    slices: int
    keys: list[np.ndarray]
    parts: list[np.ndarray]

    def find(self, level: int, key: np.ndarray) -> np.ndarray:
        """1 + place among the hot contexts of this length, or 0."""
        if not len(self.keys[level]):
            return np.zeros(len(key), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys[level], key), len(self.keys[level]) - 1)
        return np.where(self.keys[level][at] == key, at + 1, 0)

    def slice_of(self, key: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (chained(key, part) % np.uint64(self.slices)).astype(np.int64)

    def deal(self, block: Block) -> np.ndarray:
        """The slice of every token."""
        left, out = np.arange(len(block.word)), None
        for level in range(len(block.before)):
            key = block.key(left, level)
            if out is None:
                out = self.slice_of(key, np.zeros(len(key), dtype=np.int64))
            hot = self.find(level, key)
            left, key, many = left[hot > 0], key[hot > 0], self.parts[level][hot[hot > 0] - 1] if len(self.parts[level]) else hot[:0]
            if not len(left):
                break
            deeper = block.before[level + 1][left].astype(np.uint64) if level + 1 < len(block.before) else block.row[left].astype(np.uint64) + np.uint64(block.number)
            out[left] = self.slice_of(key, 1 + (scramble(deeper + np.uint64(1)) % many.astype(np.uint64)).astype(np.int64))
        return out


def hot_contexts(coded: DataFrame, v: Vocabulary, depth: int, slices: int) -> tuple[Hot, dict[int, tuple]]:
    """Hot contexts, and by key (level, context words, slices that need the counts of its next symbols): a few times ``slices`` in all."""
    names = ["c1", "c2", "c3"][:depth]

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in coded_blocks(batches, v, depth):
            at, least = np.arange(len(block.word)), max(2, len(block.word) // (4 * slices))
            for level in range(depth):
                key = block.key(at, level)
                _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                big = np.flatnonzero(n >= least)
                words = [block.before[k][at[first[big]]] if k <= level else np.full(len(big), -1) for k in range(depth)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(big), level, dtype=np.int32)), *map(pa.array, words), pa.array(n[big])], names=["level", *names, "n"])
                at = at[(n >= least)[inverse]]
                if not len(at):
                    break

    total = max(1, v.tokens)
    rows = coded.mapInArrow(heavy, f"level int, {', '.join(f'{c} long' for c in names)}, n long").groupBy("level", *names).agg(F.sum("n").alias("n"))
    found = rows.where(F.col("n") >= -(-total // slices)).collect()  # at most about depth * slices rows
    of_level: list[dict[int, tuple]] = [{} for _ in range(depth)]
    for r in found:
        words = [r[c] for c in names[: r["level"] + 1]]
        key = np.zeros(1, dtype=np.uint64)
        for w in words:
            key = chained(key, np.array([w]))
        of_level[r["level"]][int(key[0])] = (words, 1 + r["n"] * slices // total)
    order = [sorted(x) for x in of_level]
    hot = Hot(slices, [np.array(o, dtype=np.uint64) for o in order], [np.array([x[k][1] for k in o], dtype=np.int64) for o, x in zip(order, of_level, strict=True)])
    own: dict[int, tuple] = {}
    for level, o in enumerate(order):
        for key in o:
            words, many = of_level[level][key]
            places = hot.slice_of(np.full(many, key, dtype=np.uint64), 1 + np.arange(many)).tolist()
            own.setdefault(key, (level, words, set()))[2].update(places)
            upper = np.zeros(1, dtype=np.uint64)
            for k in range(level):  # a context's counts are needed where its longer hot ones are dealt to, too
                upper = chained(upper, np.array([words[k]]))
                own.setdefault(int(upper[0]), (k, words[: k + 1], set()))[2].update(places)
    return hot, own


def hot_counts(coded: DataFrame, v: Vocabulary, hot: Hot, targets: dict[int, tuple]) -> DataFrame:
    """PARTS rows of the next symbols of hot contexts and their training counts, for every slice that needs them.

    Counts are added up inside tasks, then by context and part of its next symbols, as packed lists; a context has as many parts as slices.
    """
    shared = coded.sparkSession.sparkContext.broadcast((v, hot, targets))
    listed = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])

    def added(word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, place = np.unique(word, return_inverse=True)
        return words, np.bincount(place, weights=n).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, hot, _ = shared.value
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(*at, *added(*map(np.concatenate, zip(*x, strict=True)))) for at, x in held.items()]
            for at in range(0, len(rows), 256):
                columns = zip(*((key, part, squeezed(w), squeezed(n)) for key, part, w, n in rows[at : at + 256]), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, listed.types, strict=True)], schema=listed)

        for block in coded_blocks(batches, v, len(hot.keys)):
            at = np.flatnonzero(block.train)
            for level in range(len(hot.keys)):
                key = block.key(at, level)
                which = hot.find(level, key)
                at, which = at[which > 0], which[which > 0] - 1
                if not len(at):
                    break
                part = (scramble(block.word[at].astype(np.uint64)) % hot.parts[level][which].astype(np.uint64)).astype(np.int64)
                group = which << 32 | part
                order = np.lexsort((block.word[at], group))
                group, word = group[order], block.word[at][order]
                new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])]))
                n, group, word = np.diff(np.append(new, len(group))), group[new], word[new]
                cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                for x, y in zip(cuts, [*cuts[1:], len(group)], strict=True):
                    name = int(hot.keys[level][group[x] >> 32].view(np.int64)), int(group[x] & 0xFFFFFFFF)
                    held.setdefault(name, []).append((word[x:y].copy(), n[x:y].copy()))
                size += len(group)
            if size >= SENT_SUMS:
                yield from flush()
                held.clear()
                size = 0
        yield from flush()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets, now, held = shared.value[2], None, []

        def sent() -> pa.RecordBatch:
            level, context, slices = targets[now[0] % (1 << 64)]
            words, n = added(*map(np.concatenate, zip(*held, strict=True)))
            row = (level, 0, squeezed(words), squeezed(n), *context, *[-1] * (3 - len(context)))
            columns = zip(*((place, *row) for place in sorted(slices)), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PART_SCHEMA.types, strict=True)], schema=PART_SCHEMA)

        for batch in batches:
            for key, part, words, n in zip(*(batch[c].to_pylist() for c in ("key", "part", "words", "counts")), strict=True):
                if (key, part) != now and held:
                    yield sent()
                    held = []
                now = key, part
                held.append((unsqueezed(words), unsqueezed(n)))
        if held:
            yield sent()

    lists = coded.mapInArrow(count, "key long, part int, words binary, counts binary")
    dealt = lists.repartition(shuffle_partitions(coded.sparkSession), "key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(send, PARTS)


PART_SCHEMA = pa.schema([("slice", pa.int32()), ("level", pa.int32()), ("block", pa.int64()), ("symbols", pa.binary()), ("rows", pa.binary()), *((c, pa.int64()) for c in ("c1", "c2", "c3"))])


def deal_tokens(coded: DataFrame, v: Vocabulary, depth: int, hot: Hot) -> DataFrame:
    """PARTS rows of the tokens of every block and slice: context words and word as planes, rows as 2 * row + train."""
    shared = coded.sparkSession.sparkContext.broadcast((v, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, hot = shared.value
        for block in coded_blocks(batches, v, depth):
            where = hot.deal(block)
            order = np.argsort(where * np.int64(v.unknown + 1) + block.before[0], kind="stable")  # equal words side by side compress
            cuts = np.flatnonzero(np.diff(where[order])) + 1
            rows = []
            for part in np.split(order, cuts):
                symbols = np.concatenate([*(b[part] for b in block.before), block.word[part]])
                rows.append((int(where[part[0]]), -1, block.number, squeezed(symbols), squeezed(block.row[part] * 2 + block.train[part]), None, None, None))
            for at in range(0, len(rows), 64):
                columns = zip(*rows[at : at + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PART_SCHEMA.types, strict=True)], schema=PART_SCHEMA)

    return coded.mapInArrow(run, PARTS)


def score_slice(before: list[np.ndarray], word: np.ndarray, train: np.ndarray, level: np.ndarray, n: np.ndarray, v: Vocabulary, divergence: float) -> np.ndarray:
    """log10 of P(word | longest retained state) / P(word | root) of a slice's tokens.

    level -1: a token, counted once if it is a training one; else a row of the counts n of a hot context of level + 1 words, which
    stand for all its tokens wherever they are.
    """
    root = v.root(v.counts(word))
    p = root.copy()
    key = np.zeros(len(word), dtype=np.uint64)
    inside = np.ones(len(word), dtype=bool)
    for k, symbols in enumerate(before):
        key = chained(key, symbols)
        inside &= (level < 0) | (level >= k)
        if k:
            inside &= ~((before[k - 1] == v.begin) & (symbols == v.begin))  # nothing lies before the begin
        contexts, context = np.unique(key, return_inverse=True)
        hot = np.zeros(len(contexts), dtype=bool)
        hot[context[level == k]] = True
        weight = np.where(level == k, n, np.where((level < 0) & train & ~hot[context], 1, 0)) * inside
        total = np.bincount(context, weights=weight, minlength=len(contexts))
        some = np.flatnonzero(inside & (total[context] > 1))
        if not len(some):
            break
        _, first, pair = np.unique(chained(key[some], word[some]), return_index=True, return_inverse=True)
        c = np.bincount(pair, weights=weight[some])
        of, parent = context[some[first]], p[some[first]]
        kinds = np.bincount(of, weights=c > 0, minlength=len(contexts))[of]
        t = total[of]
        without = (np.maximum(c - 1 - DISCOUNT, 0) + DISCOUNT * (kinds - (c == 1)) * parent) / (t - 1)
        gain = np.where(c > 0, c * np.log(np.maximum(without, 1e-300) / parent), 0.0)
        kept = np.bincount(of, weights=gain, minlength=len(contexts))[of] >= divergence
        own = np.where(kept, (np.maximum(c - DISCOUNT, 0) + DISCOUNT * kinds * parent) / t, parent)
        p[some] = own[pair]
    return np.log10(p / root)


def slices_of(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple]:
    """before, word, train, level, n, uid of one slice after the other, from batches sorted by slice."""
    now, held = None, []

    def joined() -> tuple:
        columns = list(zip(*held, strict=True))
        held.clear()
        return tuple(np.concatenate(columns.pop(0)) for _ in range(depth + 5))

    for batch in batches:
        numbers = (batch[c].to_pylist() for c in ("slice", "level", "block", "c1", "c2", "c3"))
        for symbols, rows, place, level, block, *context in zip(batch["symbols"], batch["rows"], *numbers, strict=True):
            if place != now and held:
                yield joined()
            now = place
            values, row = unsqueezed(symbols.as_py()), unsqueezed(rows.as_py())
            size = len(row)
            zeros = np.zeros(size, dtype=np.int64)
            if level >= 0:
                held.append((*(np.full(size, c) for c in context[:depth]), values, zeros > 0, np.full(size, level, dtype=np.int32), row, zeros))
            else:
                held.append((*values.reshape(depth + 1, -1), (row & 1).astype(bool), np.full(size, -1, dtype=np.int32), zeros, (row >> 1) + (block << ROW_BITS)))
    if held:
        yield joined()


def token_gains(parts: DataFrame, v: Vocabulary, depth: int, divergence: float) -> DataFrame:
    """uid, gain: the sum of what contexts add to the root's log10 probability of a document; sums of a block's documents travel as packed lists."""
    shared = parts.sparkSession.sparkContext.broadcast(v)
    listed = pa.schema([("block", pa.int64()), ("rows", pa.binary()), ("gains", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids: list[np.ndarray] = []
        gains: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            uid, gain = summed(np.concatenate(uids), np.concatenate(gains))
            cuts = np.flatnonzero(np.diff(uid >> ROW_BITS)) + 1
            for rows, values in zip(np.split(uid, cuts), np.split(gain, cuts), strict=True):
                if len(rows):
                    columns = rows[0] >> ROW_BITS, squeezed(rows & ((1 << ROW_BITS) - 1)), values.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, listed.types, strict=True)], schema=listed)

        for *before, word, train, level, n, uid in slices_of(batches, depth):
            gain = score_slice(before, word, train, level, n, shared.value, divergence)
            some = (level < 0) & (gain != 0)
            found, total = summed(uid[some], gain[some])
            uids.append(found)
            gains.append(total)
            if sum(map(len, uids)) >= SENT_SUMS:
                yield from flush()
                uids, gains = [], []
        if uids:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def merged() -> Iterator[pa.RecordBatch]:
            row, gain = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for at in range(0, len(row), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(row[at : at + 100_000] + (now << ROW_BITS)), pa.array(gain[at : at + 100_000])], names=["uid", "gain"])

        for batch in batches:
            for block, rows, values in zip(*(batch[c].to_pylist() for c in ("block", "rows", "gains")), strict=True):
                if block != now and held:
                    yield from merged()
                    held = []
                now = block
                held.append((unsqueezed(rows), np.frombuffer(values)))
        if held:
            yield from merged()

    lists = parts.mapInArrow(run, "block long, rows binary, gains binary")
    dealt = lists.repartition(shuffle_partitions(parts.sparkSession), "block").sortWithinPartitions("block")
    return dealt.mapInArrow(merge, "uid long, gain double")


def summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of equal keys added up, by key."""
    found, place = np.unique(key, return_inverse=True)
    return found, np.bincount(place, weights=value, minlength=len(found))


def document_sums(coded: DataFrame, v: Vocabulary) -> DataFrame:
    """uid, doc_id, held_out, n_tokens, n_known, base and root score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, sizes, ids, held in zip(*(batch[c] for c in ("block", "tokens", "sizes", "ids", "held")), strict=True):
                c, sizes = v.counts(unsqueezed(data.as_py())), sizes.values.to_numpy()
                begin = np.cumsum(sizes) - sizes
                known, base, root = (np.add.reduceat(x, begin) for x in ((c > 0).astype(np.int64), v.base(c), np.log10(v.root(c))))
                uid = np.arange(len(sizes)) + (number.as_py() << ROW_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(uid), ids.values, held.values, pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(base), pa.array(root)], names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "root"])

    return coded.mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, root double")


def score_documents(docs: DataFrame, divergence: float = DIVERGENCE, depth: int = DEPTH, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    modulus, remainder = HELD_OUT
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % modulus == remainder, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    blocks = materialize(code_texts(docs), "blocks")
    coded, v = number_words(blocks)
    discard(blocks)
    partitions = shuffle_partitions(spark)
    slices = max(4 * partitions, -(-v.tokens // slice_tokens))
    hot, targets = hot_contexts(coded, v, depth, slices)
    parts = deal_tokens(coded, v, depth, hot).unionByName(hot_counts(coded, v, hot, targets))
    dealt = parts.repartitionById(partitions, F.col("slice") % partitions).sortWithinPartitions("slice", "level")
    whole = document_sums(coded, v).join(token_gains(dealt, v, depth, divergence), "uid", "left")
    score = F.col("root") + F.coalesce("gain", F.lit(0.0))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score"))
