"""Repeated strings against brute force, suffix arrays against plain sorting."""

import hashlib
import random
from collections import Counter

import pytest

from groundmesh.llm import repeats, suffixarray

DOCS = "doc_id long, text string, n_bytes string, a string, spans string"


def brute_force(texts, width):
    raw = [(i, (t or "").encode()) for i, t in texts]
    count = Counter(t[p : p + width] for _, t in raw for p in range(len(t) - width + 1))
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if count[t[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def remove(spark, texts, width, cell=repeats.CELL):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], DOCS)
    return [tuple(r) for r in repeats.without_repeats(docs, width, cell).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc\x00\xff", bytes(range(256))])
def test_suffix_arrays_and_prefixes_are_those_of_plain_sorting(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(40):
        strings = [bytes(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(rng.randint(1, 5))]
        strings.append(strings[0][1:] + b"zz")
        text, begin = suffixarray.joined(strings)
        order = suffixarray.suffix_array(text, 1 << 20).tolist()
        suffix = {b + i: s[i:] for b, s in zip(begin.tolist(), strings, strict=True) for i in range(len(s) + 1)}
        assert sorted(order) == sorted(suffix) and [suffix[i] for i in order] == sorted(suffix.values())
        neighbour, length = suffixarray.common_prefixes(text, suffixarray.suffix_array(text, 1 << 20))
        for before, i in zip(order, order[1:]):
            x, y = suffix[before], suffix[i]
            assert neighbour[i] == before and length[i] == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_orders_to_a_depth_keep_equal_strings_together():
    rng = random.Random(9)
    strings = [bytes(rng.choices(b"ab", k=80)) for _ in range(6)]
    strings += [strings[0][:50] + b"c" + strings[0][51:], strings[1][7:]]
    for width in (3, 9, 30):
        count = Counter(s[i : i + width] for s in strings for i in range(len(s) - width + 1))
        found, begin = suffixarray.repeated_places(strings, width)
        assert found.tolist() == [b + i for b, s in zip(begin.tolist(), strings, strict=True) for i in range(len(s) - width + 1) if count[s[i : i + width]] > 1]


def corpus(rng, documents):
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(300)]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(1, 90)))) for i in range(documents)]
    passage = " ".join(rng.choices(words, k=30))
    for i in range(0, documents, 3):  # a passage that a third of all documents hold
        cut = rng.randint(0, len(texts[i][1]))
        texts[i] = (i, texts[i][1][:cut] + passage + texts[i][1][cut:])
    return texts


@pytest.mark.parametrize("cell", [repeats.CELL, 3])
def test_removed_bytes_are_those_of_brute_force(spark, cell):
    texts = corpus(random.Random(3), 90)
    near = texts[2][1] * 3
    texts += [(100, texts[1][1]), (101, texts[1][1]), (None, texts[1][1]), (None, texts[4][1]), (102, near), (103, near[:40] + "#" + near[41:]), (104, None), (105, ""), (106, "short")]
    texts += [(107, "z" * 39), (108, "y" * 40), (109, "x" * 41), (110, "w" * 500), (111, "ab" * 300), (5, texts[5][1]), (112, "é" * 30 + "日本" * 20), (113, "ü" + "日本" * 20), (114, "\0" * 60 + "\U0001f600" * 30)]
    assert ordered(remove(spark, texts, 40, cell)) == ordered(brute_force(texts, 40))


def test_every_level_finds_the_same(spark):
    texts = corpus(random.Random(8), 60)
    assert len({tuple(ordered(remove(spark, texts, 25, cell))) for cell in (0, 1, 1000)}) == 1
    assert ordered(remove(spark, texts, 25, 0)) == ordered(brute_force(texts, 25))


def test_beyond_the_broadcast_limits_nothing_changes(spark, monkeypatch):
    texts = corpus(random.Random(5), 45)
    want = ordered(brute_force(texts, 30))
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", 0)
    assert ordered(remove(spark, texts, 30, 4)) == want


def test_long_texts_are_cut_at_passes_and_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PASS_BITS", 8)
    monkeypatch.setattr(repeats, "SEGMENT", 16)
    texts = corpus(random.Random(6), 40) + [(50, "q" * 3000), (51, "qr" * 700)]
    assert ordered(remove(spark, texts, 20, 5)) == ordered(brute_force(texts, 20))


def test_one_long_text(spark):
    rng = random.Random(2)
    base = "".join(rng.choices("abcdefgh ", k=300_000))
    texts = [(1, base + base[1000:1600]), (2, "m" * 1_500_000)]
    assert ordered(remove(spark, texts, 400)) == [(1, 300_600, 1200, 2, hashlib.sha256((base[:1000] + base[1600:]).encode()).hexdigest()), (2, 1_500_000, 1_500_000, 1, hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    assert remove(spark, [(1, "a")], 5)[0][:4] == (1, 1, 0, 0)
    assert repeats.without_repeats(spark.createDataFrame([], DOCS)).collect() == []
