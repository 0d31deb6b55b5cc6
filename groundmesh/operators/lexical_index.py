"""Lexical top-k from a stored inverted index in blocks, read by upper bounds.

Items are ranged by (collection, id) and cut into blocks. A block is one row: its terms, and for each term the items whose title holds it and those
that hold it at all, as places inside the block. Columns of places are apart, so that a scan of the terms reads no postings. Nothing is tokenised
again once the index is written.

A search scans terms and title postings of all blocks, title hits being what scores differ by most and rarest. It gives every query and block an upper bound
and every title hit a lower bound; a task leaves out blocks below the k-th lower bound of those it has seen. Postings
are then read of a query's FIRST best blocks, whose k-th score is the threshold, and at last of the blocks whose bound is above the
threshold, or equal to it with a smaller id (ties go to smaller ids).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundmesh.config import Config, Phrase
from groundmesh.sources.store import checkpointed, new_folder

BLOCK_ITEMS = 256
#: Terms of all queries that are searched in one pass over the index; more queries take more passes.
PASS_TERMS = 500_000
#: Best blocks of a query that are read before the threshold is known.
FIRST = 2
DIGITS = 9
BROADCAST_PAIRS = 1_000_000
BLOCKS = "collection string, block long, first_id string, n_items int, ids array<string>, terms array<string>, n_titled array<int>, titled binary, n_held array<int>, held binary"
BOUNDS = "q int, collection string, block long, first_id string, bound double, least double"
FOUND = "q int, collection string, block long, id string, score double"


def block_rows(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
    """One block out of items in order of their ids."""
    held, titled = batch["item_terms"], batch["title_terms"]
    words = pc.list_flatten(held).dictionary_encode()
    known = words.dictionary

    def postings(term: np.ndarray, column: pa.Array) -> tuple[np.ndarray, bytes]:
        item = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(column), 0).to_numpy())
        item, term = item[term >= 0], term[term >= 0]
        order = np.lexsort((item, term))
        return np.bincount(term, minlength=len(known)).astype(np.int32), item[order].astype("<u2").tobytes()

    n_titled, titles = postings(pc.fill_null(pc.index_in(pc.list_flatten(titled), value_set=known), -1).to_numpy(), titled)
    n_held, items = postings(words.indices.to_numpy(), held)
    row = ([batch["collection"][0].as_py()], [number], [batch["id"][0].as_py()], [batch.num_rows], [batch["id"].to_pylist()], [known.to_pylist()], [n_titled], [titles], [n_held], [items])
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, SCHEMA.types, strict=True)], schema=SCHEMA)


SCHEMA = pa.schema([("collection", pa.string()), ("block", pa.int64()), ("first_id", pa.string()), ("n_items", pa.int32()), ("ids", pa.list_(pa.string())), ("terms", pa.list_(pa.string())), ("n_titled", pa.list_(pa.int32())), ("titled", pa.binary()), ("n_held", pa.list_(pa.int32())), ("held", pa.binary())])


@dataclass(frozen=True)
class LexicalIndex:
    """The written blocks. Open it again with ``LexicalIndex.stored``."""

    blocks: DataFrame

    @staticmethod
    def stored(spark: SparkSession, folder: str) -> LexicalIndex:
        return LexicalIndex(spark.read.schema(BLOCKS).parquet(folder))

    @staticmethod
    def write(items: DataFrame, folder: str | None = None, block_items: int = BLOCK_ITEMS, stored: bool = False) -> LexicalIndex:
        """Index items (collection, id, item_terms, title_terms). Without a folder, a new one of the checkpoint folder is taken. ``stored``: the items are a written table."""
        if not 0 < block_items <= 1 << 16:
            raise ValueError("a block holds 1 to 65,536 items")
        spark = items.sparkSession

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            rows: pa.Table | None = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                rows = table if rows is None else pa.concat_tables([rows, table])
                while rows.num_rows:
                    kinds = rows["collection"]
                    same = pc.index(pc.equal(kinds, kinds[0]), False).as_py()
                    size = min(block_items, rows.num_rows if same < 0 else same)
                    if size < block_items and same < 0:
                        break  # the block may go on in the next batch
                    yield block_rows(rows.slice(0, size).combine_chunks().to_batches()[0], number)
                    rows, number = rows.slice(size), number + 1
            if rows is not None and rows.num_rows:
                yield block_rows(rows.combine_chunks().to_batches()[0], number)

        terms = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
        rows = items.select(F.coalesce("collection", F.lit("")).alias("collection"), "id", terms("item_terms"), F.array_intersect(terms("title_terms"), terms("item_terms")).alias("title_terms")).where(F.col("id").isNotNull())
        rows = rows if stored else checkpointed(rows)  # ranges are sampled first, and texts are not to be tokenised for that
        ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "collection", "id").sortWithinPartitions("collection", "id")
        folder = folder or new_folder(spark, "lexical")
        ranged.mapInArrow(run, BLOCKS).write.parquet(folder)
        return LexicalIndex.stored(spark, folder)


@dataclass(frozen=True)
class QueryTerms:
    """Queries of one pass: their terms in order, and the queries (by number) of each."""

    terms: pa.Array
    begin: np.ndarray
    queries: np.ndarray
    phrases: list[tuple[np.ndarray, np.ndarray, int, float]]
    limit: int

    @staticmethod
    def of(rows: list[list[str]], phrases: list[Phrase], limit: int) -> QueryTerms:
        pairs = sorted({(t, q) for q, terms in enumerate(rows) for t in terms})
        words = sorted({t for t, _ in pairs})
        place = {t: n for n, t in enumerate(words)}
        of_term = np.array([place[t] for t, _ in pairs], dtype=np.int64)
        listed = []
        for p in phrases:  # places of its terms, and the queries that hold them all
            if all(t in place for t in p.terms):
                whole = [q for q, terms in enumerate(rows) if set(p.terms) <= set(terms)]
                listed.append((np.array(sorted({place[t] for t in p.terms})), np.array(whole, dtype=np.int64), len(set(p.terms)), p.boost))
        return QueryTerms(pa.array(words, pa.string()), np.searchsorted(of_term, np.arange(len(words) + 1)), np.array([q for _, q in pairs], dtype=np.int64), listed, limit)

    def meet(self, term: np.ndarray, item: np.ndarray, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, term) of every posting whose term is a query's; ``some``: mask of the queries asked."""
        size = self.begin[term + 1] - self.begin[term]
        at = np.repeat(self.begin[term] - np.cumsum(size) + size, size) + np.arange(size.sum())
        query, item, term = self.queries[at], np.repeat(item, size), np.repeat(term, size)
        if some is not None:
            query, item, term = (x[keep] for keep in [some[query]] for x in (query, item, term))
        return query, item, term


def scored(overlap: np.ndarray, titled: np.ndarray, boost: np.ndarray | float) -> np.ndarray:
    return np.round(np.minimum(0.98, 0.45 + np.minimum(0.25, 0.04 * overlap) + np.minimum(0.25, 0.08 * titled) + boost), DIGITS)


def postings(known: np.ndarray, counts: pa.Scalar, data: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """(query term, item) of all postings of a block whose term is ``known`` (-1 elsewhere)."""
    counts = counts.values.to_numpy()
    term = np.repeat(known, counts)
    mine = term >= 0
    return term[mine], np.frombuffer(data.as_buffer(), "<u2")[mine].astype(np.int64)


def known_terms(terms: pa.Scalar, asked: QueryTerms) -> np.ndarray:
    return pc.fill_null(pc.index_in(terms.values, value_set=asked.terms), -1).to_numpy().astype(np.int64)


def bounds(blocks: DataFrame, asked: QueryTerms, count: int) -> DataFrame:
    """BOUNDS: an upper bound for each query and block that may matter; rows without a block hold a query's best lower bounds of a task."""
    shared = blocks.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best: dict[str, np.ndarray] = {}
        for batch in batches:
            for kind, number, first, terms, n_titled, titled in zip(*(batch[c] for c in ("collection", "block", "first_id", "terms", "n_titled", "titled")), strict=True):
                known = known_terms(terms, asked)
                present = known[known >= 0]
                query, _, term = asked.meet(present, np.zeros(len(present), dtype=np.int64))
                overlap = np.bincount(query, minlength=count)
                boost = np.zeros(count)
                for places, whole, _, value in asked.phrases:
                    if np.isin(places, present).all():
                        boost[whole] += value
                query, item, _ = asked.meet(*postings(known, n_titled, titled))
                pair, hits = np.unique(query << 16 | item, return_counts=True)
                query = pair >> 16
                most = np.zeros(count, dtype=np.int64)
                np.maximum.at(most, query, hits)
                kept = best.setdefault(kind.as_py(), np.full((count, asked.limit), -1.0))
                if len(query):  # the best lower bounds of each query, those of the block among them
                    least = scored(hits, hits, 0.0)
                    order = np.lexsort((-least, query))
                    query, least = query[order], least[order]
                    place = np.arange(len(query)) - np.searchsorted(query, query)
                    query, least, place = (x[place < asked.limit] for x in (query, least, place))
                    some = np.unique(query)
                    new = np.full((len(some), asked.limit), -1.0)
                    new[np.searchsorted(some, query), place] = least
                    kept[some] = -np.sort(-np.concatenate([kept[some], new], axis=1), axis=1)[:, : asked.limit]
                bound = scored(overlap, most, boost)
                q = np.flatnonzero((overlap > 0) & (bound >= kept[:, -1]))
                yield rows(q, kind.as_py(), number.as_py(), first.as_py(), bound[q], None)
        for kind, kept in best.items():
            q, at = np.nonzero(kept >= 0)
            yield rows(q, kind, None, None, None, kept[q, at])

    def rows(q: np.ndarray, kind: str, block: int | None, first: str | None, bound: np.ndarray | None, least: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(q), pa.float64())
        same = lambda v, t: pa.array([v] * len(q), t)
        return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), same(kind, pa.string()), same(block, pa.int64()), same(first, pa.string()), none if bound is None else pa.array(bound), none if least is None else pa.array(least)], names=["q", "collection", "block", "first_id", "bound", "least"])

    return blocks.select("collection", "block", "first_id", "terms", "n_titled", "titled").mapInArrow(run, BOUNDS)


def read_blocks(blocks: DataFrame, wanted: DataFrame, asked: QueryTerms, count: int) -> DataFrame:
    """FOUND: the best ``limit`` items of each wanted (q, collection, block), scored from the block's postings."""
    shared = blocks.sparkSession.sparkContext.broadcast(asked)
    lists = checkpointed(wanted.groupBy("collection", "block").agg(F.collect_list("q").alias("asked")))  # no more than the queries of a pass
    size = lists.agg(F.coalesce(F.sum(F.size("asked")), F.lit(0)).alias("n")).first()["n"]
    met = blocks.join(F.broadcast(lists) if size <= BROADCAST_PAIRS else lists, ["collection", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            for kind, number, ids, terms, n_titled, titled, n_held, held, wanted in zip(*batch.columns, strict=True):
                some = np.zeros(count, dtype=bool)
                some[wanted.values.to_numpy()] = True
                known = known_terms(terms, asked)
                query, item, term = asked.meet(*postings(known, n_held, held), some)
                pair, place, overlap = np.unique(query << 16 | item, return_inverse=True, return_counts=True)
                boost = np.zeros(len(pair))
                for places, whole, size, value in asked.phrases:
                    boost += value * ((np.bincount(place[np.isin(term, places)], minlength=len(pair)) == size) & np.isin(pair >> 16, whole))
                query, item, _ = asked.meet(*postings(known, n_titled, titled), some)
                at, hits = np.unique(query << 16 | item, return_counts=True)
                in_title = np.zeros(len(pair), dtype=np.int64)
                in_title[np.searchsorted(pair, at)] = hits
                score, query, item = scored(overlap, in_title, boost), pair >> 16, pair & 0xFFFF
                order = np.lexsort((item, -score, query))  # items are in order of their ids
                query, item, score = query[order], item[order], score[order]
                kept = np.arange(len(query)) - np.searchsorted(query, query) < asked.limit
                names = ids.values.take(pa.array(item[kept]))
                yield pa.RecordBatch.from_arrays([pa.array(query[kept].astype(np.int32)), pa.array([kind.as_py()] * len(names), pa.string()), pa.array(np.full(len(names), number.as_py())), names, pa.array(score[kept])], names=["q", "collection", "block", "id", "score"])

    return met.select("collection", "block", "ids", "terms", "n_titled", "titled", "n_held", "held", "asked").mapInArrow(run, FOUND)


def search_pass(rows: list[list[str]], index: LexicalIndex, cfg: Config, limit: int) -> tuple[DataFrame, DataFrame]:
    """(FOUND rows, (q, collection, block, bound) of every block read) of the queries of one pass."""
    asked, count = QueryTerms.of(rows, [p for p in cfg.phrases if p.lexical], limit), len(rows)
    seen = checkpointed(bounds(index.blocks, asked, count))
    nth = lambda df, order: df.withColumn("_n", F.row_number().over(W.partitionBy("q", "collection").orderBy(*order))).where(F.col("_n") == limit).drop("_n")
    floor = nth(seen.where("block IS NULL"), [F.desc("least")]).select("q", "collection", F.col("least").alias("floor"))
    wanted = seen.where("block IS NOT NULL").join(floor, ["q", "collection"], "left").where(F.col("bound") >= F.coalesce("floor", F.lit(-1.0)))
    wanted = checkpointed(wanted.select("q", "collection", "block", "first_id", "bound").withColumn("_n", F.row_number().over(W.partitionBy("q", "collection").orderBy(F.desc("bound"), "first_id"))))
    first = checkpointed(read_blocks(index.blocks, wanted.where(F.col("_n") <= FIRST), asked, count))
    threshold = nth(first, [F.desc("score"), "id"]).select("q", "collection", F.col("score").alias("least"), F.col("id").alias("last_id"))
    rest = wanted.where(F.col("_n") > FIRST).join(threshold, ["q", "collection"], "left")
    rest = checkpointed(rest.where(F.col("least").isNull() | (F.col("bound") > F.col("least")) | (F.col("bound") == F.col("least")) & (F.col("first_id") < F.col("last_id"))).drop("least", "last_id"))
    found = first.unionByName(read_blocks(index.blocks, rest, asked, count))
    read = wanted.where(F.col("_n") <= FIRST).unionByName(rest).select("q", "collection", "block", "bound")
    return found, read


def lexical_search(queries: DataFrame, index: LexicalIndex, cfg: Config, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, terms) -> (query_id, collection, id, score, rank) of the best ``limit`` items of each collection, and
    (query_id, collection, block, bound) of every block whose postings were read.

    Queries go to the driver in passes of PASS_TERMS terms, those without terms don't.
    """
    spark, limit = queries.sparkSession, limit or cfg.lexical_limit
    kind = queries.schema["query_id"].dataType.simpleString()
    rows = checkpointed(queries.where(F.size("terms") > 0).select("query_id", "terms"))
    found = read = None

    def search(held: list) -> None:
        nonlocal found, read
        names = spark.createDataFrame([(n, r["query_id"]) for n, r in enumerate(held)], f"q int, query_id {kind}")
        hits, blocks = (x.join(F.broadcast(names), "q").drop("q") for x in search_pass([r["terms"] for r in held], index, cfg, limit))  # names: the queries of a pass
        found, read = (hits, blocks) if found is None else (found.unionByName(hits), read.unionByName(blocks))

    held, terms = [], 0
    for row in rows.toLocalIterator():
        held.append(row)
        terms += len(row["terms"])
        if terms >= PASS_TERMS:
            search(held)
            held, terms = [], 0
    if held or found is None:
        search(held)
    best = W.partitionBy("query_id", "collection").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return ranked.select("query_id", "collection", "id", "score", "rank"), read
