"""The stored lexical index against scoring every item."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from groundmesh.config import Config, Phrase
from groundmesh.operators import lexical_index
from groundmesh.operators.lexical_index import LexicalIndex, lexical_search

CFG = Config(phrases=(Phrase(("wa", "wb"), 0.3, True), Phrase(("wc", "wd"), 0.1)))


def corpus(rng, n):
    words = [f"w{c}" for c in "abcdefghij"] + [f"x{i}" for i in range(300)]
    weights = [30] * 10 + [1] * 300
    out = []
    for i in range(n):
        body = sorted(set(rng.choices(words, weights, k=rng.randint(0, 25))))
        title = sorted(set(rng.choices(words, weights, k=rng.randint(0, 3))))
        out.append((rng.choice(["text", "text", "image"]), f"id{rng.randint(0, 10**6):06d}-{i}", sorted({*body, *title[:2]}), title))
    return out


def plainly(queries, items, limit):
    out = []
    for q, terms in queries:
        for kind in ("text", "image"):
            scored = []
            for collection, i, body, title in items:
                both = set(terms or ()) & set(body)
                if collection == kind and both:
                    boost = sum(p.boost for p in CFG.phrases if p.lexical and set(p.terms) <= both)
                    scored.append((-round(min(0.98, 0.45 + min(0.25, 0.04 * len(both)) + min(0.25, 0.08 * len(both & set(title))) + boost), 9), i))
            out += [(q, kind, i, -s, n) for n, (s, i) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    items = corpus(rng, 900)
    words = [f"w{c}" for c in "abcdefghij"] + [f"x{i}" for i in range(300)]
    queries = [(f"q{i}", sorted(set(rng.choices(words, [5] * 10 + [1] * 300, k=rng.randint(1, 30))))) for i in range(25)] + [("none", []), ("null", None), ("unknown", ["zzz"]), ("phrase", ["wa", "wb", "x1"])]
    return items, queries, spark.createDataFrame(items, "collection string, id string, item_terms array<string>, title_terms array<string>"), spark.createDataFrame(queries, "query_id string, terms array<string>")


def found(hits):
    return sorted((r.query_id, r.collection, r.id, round(r.score, 9), r["rank"]) for r in hits.collect())


@pytest.mark.parametrize(("block_items", "limit"), [(7, 5), (64, 1), (64, 2000), (4096, 5)])
def test_answers_are_those_of_scoring_everything(tables, block_items, limit):
    items, queries, df, asked = tables
    hits, _ = lexical_search(asked, LexicalIndex.write(df, block_items=block_items), CFG, limit)
    assert found(hits) == plainly(queries, items, limit)


def test_passes_shuffled_joins_and_a_reopened_index(spark, tables, monkeypatch, tmp_path):
    items, queries, df, asked = tables
    monkeypatch.setattr(lexical_index, "PASS_TERMS", 60)
    monkeypatch.setattr(lexical_index, "BROADCAST_PAIRS", 0)
    LexicalIndex.write(df, str(tmp_path / "index"), block_items=20)
    hits, _ = lexical_search(asked, LexicalIndex.stored(spark, str(tmp_path / "index")), CFG, 4)
    assert found(hits) == plainly(queries, items, 4)


def test_blocks_read_fall_with_k(tables):
    _, _, df, asked = tables
    index = LexicalIndex.write(df, block_items=8)
    blocks = index.blocks.count()
    read = [lexical_search(asked, index, CFG, k)[1].count() for k in (1, 10, 1000)]
    assert read == sorted(read) and read[0] < read[-1] / 2 and read[-1] <= blocks * 28
    kept = lexical_search(asked, index, CFG, 10)[1].groupBy("query_id", "collection", "block").count()
    assert kept.where(F.col("count") > 1).count() == 0  # no block is read twice for a query


def test_blocks_hold_every_posting(tables):
    items, _, df, _ = tables
    got = Counter()
    for r in LexicalIndex.write(df, block_items=50).blocks.collect():
        assert r.n_items == len(r.ids) <= 50 and r.ids == sorted(r.ids) and r.first_id == r.ids[0]
        for term, n in zip(r.terms, r.n_held):
            got[term] += n
        assert sum(r.n_held) * 2 == len(r.held) and sum(r.n_titled) * 2 == len(r.titled)
    assert got == Counter(t for *_, body, _ in items for t in body)


def test_no_items_and_no_queries(spark, tables):
    _, _, df, asked = tables
    empty = LexicalIndex.write(df.limit(0))
    assert found(lexical_search(asked, empty, CFG, 5)[0]) == []
    assert found(lexical_search(asked.limit(0), LexicalIndex.write(df), CFG, 5)[0]) == []
    with pytest.raises(ValueError, match="65,536"):
        LexicalIndex.write(df, block_items=1 << 17)
