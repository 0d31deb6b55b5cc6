"""Each operator against brute force on small tables, with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from groundmesh.llm import fingerprints, licenses, mixing, neardup, packing, quality, suffixtree, tokens, topk, toxicity, warc
from groundmesh.llm.common import materialize
from groundmesh.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep string, _evidence string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, 0, "k", "e") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(4)
    vocabulary = ["the", "of", "and", "The", "of,"] + ["".join(rng.choices("abcdeé", k=rng.randint(3, 8))) for _ in range(150)]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 120)))) for i in range(60)]
    texts += [(60, texts[0][1]), (61, texts[0][1].upper()), (62, " ".join(texts[1][1].split()[:-1])), (63, ""), (64, None), (65, "one two"), (66, " \n"), (67, texts[2][1] + " x y z"), (5, texts[5][1])]
    return texts


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_license_scan(spark, prose):
    texts = [*prose, (70, "Released under the MIT License. x (mit license)"), (71, "licensed under GNU General Public License, version 3 GNU general public license"), (72, "gnu general public licence"), (None, "CC BY-NC 4.0")]
    rows = licenses.scan_licenses(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        at, labels = [], set()
        for label, phrase in licenses.BASE_PHRASES.items():
            p = phrase.split()
            found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            at, labels = at + found, labels | ({label} if found else set())
        want = (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert want in [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in by[i]]
    assert "gpl-3.0" in by[71][0].labels.split(",") and "cc-by-nc" in by[None][0].labels and by[72][0].labels == ""
    assert licenses.scan_licenses(documents(spark, []).limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=16).round(2).tolist()) for i in range(400)]
    vectors += [(400 + i, vectors[0][1]) for i in range(5)] + [(500, None), (501, [float("nan")] * 16), (550, [None] * 16), (503, []), (600, [1.0, 2.0]), (350, vectors[3][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, rank string").repartition(4)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, dimension_block=4).collect())
    whole = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in vectors if v and None not in v and np.isfinite(v).all()]
    want = []
    for i, q in whole:
        if i % 50 == 0:
            best = sorted((-int(q @ x), j) for j, x in whole if j != i and len(x) == len(q))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_top_k_of_large_numbers(spark, monkeypatch):
    big = 1152921504606847000
    rng = np.random.default_rng(7)
    vectors = [(i, [float(x) for x in rng.integers(-(2**21), 2**21, 8)]) for i in range(60)] + [(None, [1.0] * 8), (big, [5.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    whole = [(i, [int(256 * x) for x in v]) for i, v in vectors if i is not None]
    want = [(i, n + 1, j, -s) for i, q in whole if i % 50 == 0 or i == big for n, (s, j) in enumerate(sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in whole if j != i)[:5])]
    assert max(abs(w[3]) for w in want) > 2**53
    for limit in (topk.BROADCAST_BYTES, 1):  # the second: several groups and copies of the queries
        monkeypatch.setattr(topk, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(topk, "QUERY_BLOCK", 1)
        got = topk.top_k(df, (F.col("vec_id") % 50 == 0) | (F.col("vec_id") == big), 5, dimension_block=2)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == sorted(want)
    with pytest.raises(Exception, match="beyond 2"):
        topk.top_k(spark.createDataFrame([(0, [2.0**50]), (1, [2.0**50])], df.schema), F.col("vec_id") == 0, 5).collect()


def brute_components(texts, above=75):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)]) if w else frozenset())
    parent = {i: i for i in sets}

    def find(a):
        return a if parent[a] == a else find(parent[a])

    for i in sets:
        for j in sets:
            if i < j and any(100 * len(a & b) >= above * len(a | b) > 0 for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, sets


def test_near_duplicates(spark, prose):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    family = []
    for i in range(60):  # a large group of near copies whose pairs lie on both sides of the threshold
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(150)] = f"e{rng.random()}"
        family.append((1000 + i, " ".join(words)))
    shared = " ".join(f"p{k}" for k in range(60))
    texts = [*prose, *family, *((2000 + i, shared + " " + " ".join(f"u{i}x{k}" for k in range(90))) for i in range(30)), (None, "one two")]
    rows = neardup.near_duplicates(documents(spark, texts).repartition(3)).collect()
    want, sets = brute_components([x for x in texts if x[0] is not None])
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]} and r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id]), r
    extra = [(None, "one two"), (None, texts[3][1]), (None, "w1 of its own"), (0, "the same id but another text of some length"), (None, None)]
    kept = Counter((r.doc_id, r.text) for r in neardup.without_near_duplicates(documents(spark, [*texts, *extra])).collect())
    by_row = [(n, t) for n, (_, t) in enumerate([*texts, *extra])]
    groups = defaultdict(list)
    for n, component in brute_components(by_row)[0].items():
        groups[component].append(n)
    row = [*texts, *extra]
    first = [min(g, key=lambda n: (row[n][0] is None, row[n][0] or 0, n)) for g in groups.values()]
    assert kept == Counter(row[n] for n in first) and kept[0, extra[3][1]] == 1
    assert neardup.near_duplicates(documents(spark, prose).limit(0)).count() == 0


def test_components_of_a_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0 and got[129] == 100
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_suffix_tree(texts, depth):
    """Score of every text by a tree of dictionaries."""
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    runs = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", lowered(t)), "\0"]) for i, t in texts]
    contexts = lambda w, k: [("^",) * (n > k) + tuple(w[max(0, k - n) : k]) for n in range(1, min(k + 1, depth) + 1)]
    after = defaultdict(Counter)
    for i, w in runs:
        if not out(i):
            for k in range(len(w)):
                for state in [(), *contexts(w, k)]:
                    after[state][w[k]] += 1
    c, n = after[()], sum(after[()].values())
    ones, twos = (sum(x == k for x in c.values()) for k in (1, 2))
    d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.05
    memo, e = {}, suffixtree.DISCOUNT

    def chance(state, w):
        """P(w | longest retained suffix of state)."""
        if not state:
            return (c[w] - d) / n if c[w] else d * len(c) / n
        seen = after.get(state, {})
        total, kinds = sum(seen.values()), len(seen)
        if state not in memo:
            lower = {x: chance(state[1:], x) for x in seen}
            memo[state] = total > 1 and sum(m * np.log(max((max(m - 1 - e, 0) + e * (kinds - (m == 1)) * lower[x]) / (total - 1), 1e-300) / lower[x]) for x, m in seen.items()) >= suffixtree.DIVERGENCE
        p = chance(state[1:], w)
        return (max(seen.get(w, 0) - e, 0) + e * kinds * p) / total if memo[state] else p

    scores = [(i, sum(np.log10(chance(contexts(w, k)[-1], w[k])) for k in range(len(w)))) for i, w in runs]
    return scores, memo


def test_suffix_tree(spark, prose):
    rng = random.Random(1)
    phrase = "alpha beta gamma delta epsilon zeta"
    texts = [*prose, *((200 + i, f"{phrase} {rng.random()} {phrase}") for i in range(60)), (None, "the of"), (300, "long text of many words " * 20_000)]
    rows = suffixtree.score_documents(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lowered(t)), "\0"]
    c = Counter(w for i, t in texts if not out(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, out(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 3)) for i, t in texts)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in rows) == want
    scores, memo = brute_suffix_tree(texts, suffixtree.DEPTH)
    assert sorted((r.doc_id or -1, r.score) for r in rows) == [(i, pytest.approx(s)) for i, s in sorted((i or -1, s) for i, s in scores)]
    assert any(memo.values()) and not all(memo.values())
    assert suffixtree.score_documents(documents(spark, prose).limit(0)).count() == 0
    only = suffixtree.score_documents(documents(spark, [(7, "a b")]).withColumn("doc_id", F.lit(next(i for i in range(99) if out(i))))).first()
    assert (only.train_tokens, only.base_score, only.score) == (0, 0.0, 0.0)


@pytest.mark.parametrize(("depth", "slice_tokens"), [(3, 1_000_000), (3, 150), (2, 20)])
def test_suffix_tree_with_hot_contexts(spark, depth, slice_tokens):
    """Many small slices make words, pairs and triples hot; where tokens are dealt to must not change a score."""
    rng = random.Random(3)
    texts = []
    for i in range(80):
        words = rng.choices(["the", "of", "and", "to", *(f"w{k}" for k in range(25))], k=30)
        for _ in range(6):
            words += rng.choice([["of", "the", "sea"], ["the", "land"], ["w1", "w2", "w3"], ["to", "w2", "w4"]])
        texts.append((i, " ".join(words)))
    texts += [(i, "a b " * 40) for i in range(100, 120)]
    scores, memo = brute_suffix_tree(texts, depth)
    assert memo["of", "the"] and memo["the",] and not all(memo.values())
    docs = documents(spark, texts).repartition(3)
    if slice_tokens < 1000:
        coded, v = suffixtree.number_words(materialize(suffixtree.code_texts(docs.select("doc_id", F.lit(False).alias("held_out"), "text")), "blocks"))
        hot, _ = suffixtree.hot_contexts(coded, v, depth, v.tokens // slice_tokens)
        assert all(len(k) for k in hot.keys)
    got = {r.doc_id: r.score for r in suffixtree.score_documents(docs, depth=depth, slice_tokens=slice_tokens).collect()}
    assert got == pytest.approx(dict(scores))


def test_suffix_tree_planes():
    rng = np.random.default_rng(0)
    for top in (1, 200, 70_000, 1 << 40):
        x = rng.integers(0, top, 1000)
        assert (suffixtree.unsqueezed(suffixtree.squeezed(x)) == x).all()


def labelled_corpus():
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(700):
        words = [rng.choice(["good", "plain", "text", "word", "the", "of"]) + rng.choice(["", "s", "ing", "er"]) + f"{rng.randint(0, 40)}" for _ in range(rng.randint(20, 80))]
        toxic, bad = i % 8 == 0, i % 7 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "nastything", f"slurpre{rng.randint(0, 50)}"]))
        text = " ".join(words).capitalize() + "."
        if bad:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(w for w in words for _ in range(6)), text.replace(" ", "### "), text.replace(" ", " | ")])
        rows.append((i, text))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_toxicity_and_quality(spark):
    rows, labels = labelled_corpus()
    docs = documents(spark, [*rows, (9000, None), (9001, ""), (None, "plain text")])
    marks = spark.createDataFrame([*labels, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 703 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held)
    right = sum(got[i].predicted == (i % 8 == 0) for i in held)
    assert right / len(held) > 0.97 and got[9000].predicted == got[9001].predicted == 0
    clean = toxicity.clean_documents(docs, model)
    assert clean.columns == docs.columns and clean.where("doc_id < 700 AND doc_id % 8 = 0").count() <= 4
    scored = {r.doc_id: r for r in quality.score_documents(docs, marks).collect()}
    assert sum(scored[i].keep == (i % 7 != 0) for i, _ in rows) / len(rows) > 0.97
    kept = quality.filter_documents(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in scored.items() if r.keep}
    none = marks.limit(0)
    assert quality.filter_documents(docs, none).count() == 703 and toxicity.clean_documents(docs, toxicity.fit(docs, none)).count() == 703
    assert quality.score_documents(docs.limit(0), marks).count() == 0 and toxicity.score(docs.limit(0), model).count() == 0


def test_maximal_segments():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.integers(-3, 4, rng.integers(1, 25)).astype(float)
        got = toxicity.maximal_segments(s)
        total = np.concatenate([[0], np.cumsum(s)])
        best = max((total[j] - total[i] for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        assert max((x for _, _, x in got), default=0) == max(best, 0)
        assert all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:], strict=False)) and all(np.isclose(s[a:b].sum(), x) and x > 0 for a, b, x in got)


def test_fingerprints(spark, prose):
    texts = [x for n, x in enumerate(prose) if x[0] not in {y[0] for y in prose[:n]}]
    rows = {r.doc_id: r for r in fingerprints.fingerprint_neighbours(documents(spark, texts).repartition(3)).collect()}
    order = sorted(dict(texts), reverse=True)
    own = {i: t or "" for i, t in texts}
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(documents(spark, texts)).collect()}
    for i, following in zip(order, order[1:] + order[:1], strict=True):
        cut = len(own[i]) // 3
        edited = own[i][: len(own[i]) - cut] + own[following][:cut]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(own[i]), hashlib.sha256(edited.encode()).hexdigest(), prints[i])
        assert r.near_next == fingerprints.likeness(fingerprints.order_min_hash(own[i]), fingerprints.order_min_hash(own[following]))
    assert prints[0] == prints[60] != prints[61]
    assert fingerprints.fingerprint_neighbours(documents(spark, texts).limit(0)).count() == 0
    one = fingerprints.fingerprint_neighbours(documents(spark, texts).where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_on_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKETS", 40)
    texts = [(3 * i - 100, f"text number {i} " * (i % 7)) for i in range(200)] + [(50, "b"), (50, "a")]
    own = sorted(((-i, t) for i, t in texts))  # descending id, ties by text
    rows = Counter((r.doc_id, r.edited_sha256, r.near_edited, r.edited_fingerprint) for r in fingerprints.fingerprint_neighbours(documents(spark, texts).repartition(4)).collect())
    want = Counter()
    for (i, t), (_, following) in zip(own, own[1:] + own[:1], strict=True):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        a, b = fingerprints.order_min_hash(t), fingerprints.order_min_hash(edited)
        want[-i, hashlib.sha256(edited.encode()).hexdigest(), fingerprints.likeness(a, b), b.astype(">u4").tobytes().hex()] += 1
    assert rows == want
    for cuts in ([], [4], list(range(0, 40, 3))):
        got = [r.b for r in spark.range(-2, 45).select(fingerprints.smaller(F.col("id"), cuts).alias("b")).collect()]
        assert got == [sum(c < x for c in cuts) for x in range(-2, 45)]


def brute_order_min_hash(text, k=fingerprints.K):
    """The smallest pairs by the same hashes, over lists of places instead of arrays."""
    codes = [ord(c) for c in text]
    while k > len(codes):
        k //= 2
    h = [int(fingerprints.scramble(fingerprints.kmer_hashes(np.array(codes[i : i + k], dtype=np.uint32), k))[0]) for i in range(len(codes) - k + 1)]
    seen, pairs = Counter(), []
    for x in h:
        pairs.append(int(fingerprints.scramble(np.array([(x + seen[x >> 20] * int(fingerprints.MIX)) % (1 << 64)], dtype=np.uint64))[0]) >> 32)
        seen[x >> 20] += 1
    out = []
    for m, a in zip(fingerprints.MULTIPLIERS.tolist(), fingerprints.ADDENDS.tolist(), strict=True):
        places = sorted(sorted(range(len(h)), key=lambda i: ((pairs[i] * m + a) % (1 << 32), i))[: fingerprints.TUPLE])
        total = np.zeros(1, dtype=np.uint64)
        for i in places:
            total = fingerprints.scramble(total * fingerprints.MIX + np.uint64(h[i] ^ pairs[i]))
        out.append(int(total[0]) >> 32)
    return out


def test_order_min_hash_by_brute_force(prose):
    with np.errstate(over="ignore"):
        for _, text in [*prose[:12], (0, "abc"), (0, "é"), (0, "ab" * 40)]:
            if text:
                assert fingerprints.order_min_hash(text).tolist() == brute_order_min_hash(text)


def test_occurrences_and_order():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 4, 200).astype(np.uint64) << np.uint64(40)
    seen = Counter()
    for value, got in zip(h.tolist(), fingerprints.occurrences(h).tolist(), strict=True):
        assert got == seen[value]
        seen[value] += 1
    long = rng.integers(0, 5, (1 << 20) + 7).astype(np.uint64) << np.uint64(40)  # very long texts take the other sort
    assert all((fingerprints.occurrences(long)[long == v] == np.arange((long == v).sum())).all() for v in np.unique(long))
    a = "the quick brown fox jumps over the lazy dog and runs away from home " * 3
    swapped = a[100:] + a[:100]
    alike = fingerprints.likeness(fingerprints.order_min_hash(a), fingerprints.order_min_hash(swapped))
    assert alike < 1.0


def test_warc(spark, tmp_path):
    pages = [(i, f"http://x/{i}", f"<p>{'y' * (i % 4) * 60}</p>") for i in range(40)] + [(40, None, None), (None, "u", "z" * 200), (3, "http://x/3", "<p>" + "y" * 180 + "</p>"), (41, "u", "z" * 200)]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, payload string")
    rows = warc.round_trip(df).collect()
    assert len(rows) == len(pages)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h] = min(first.get(h, i), i)
    want = Counter()
    for i, _, h in pages:
        b = (h or "").encode()
        again = len(b) >= 100 and (i is None or i > first[h])
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    assert warc.round_trip(df.limit(0)).count() == 0
    archive = warc.write_archives(warc.plan_records(df)).first().content
    (tmp_path / "a.warc.zst").write_bytes(archive)
    assert warc.read_warc_files(spark, str(tmp_path)).where("record_type = 'response'").count() > 0
    for broken in (archive[:-3], archive[8:], archive[: len(archive) // 2]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.iterate_archive(bytes(broken)))


def brute_schedule(blocks, weights):
    """Slot by slot over fractions: among the released blocks, the earliest deadline (then the smaller source)."""
    left, used, order = {k: n for k, n in blocks.items() if n}, Counter(), []
    while left:
        share = {k: Fraction(weights[k]) / sum(Fraction(weights[x]) for x in left) for k in left}
        base, done = len(order), Counter()
        while True:
            released = [k for k in left if math.floor(done[k] / share[k]) <= len(order) - base]
            k = min(released, key=lambda x: (math.ceil((done[x] + 1) / share[x]), x))
            order.append((k, used[k]))
            done[k] += 1
            used[k] += 1
            for x in left:
                assert abs(done[x] - share[x] * (len(order) - base)) < 1
            if used[k] == blocks[k]:
                del left[k]
                break
    return order


def test_mixing(spark, prose, monkeypatch):
    docs = documents(spark, prose)
    for weights in (None, {"s0": 0.7, "s1": 1 / 3}):
        rows = mixing.mix(docs, weights, block_docs=2).collect()
        counts = Counter(r.mix_source for r in rows)
        chosen = {k: n**0.5 for k, n in counts.items()} if weights is None else weights | dict.fromkeys(set(counts) - set(weights), 1 / 3)
        place, position = {}, 0
        for slot, (k, block) in enumerate(brute_schedule({k: -(-n // 2) for k, n in counts.items()}, chosen)):
            place[k, block] = slot, position
            position += min(2, counts[k] - 2 * block)
        assert sorted(r.mix_position for r in rows) == list(range(len(prose)))
        for r in rows:
            slot, position = place[r.mix_source, r.mix_block]
            assert r.mix_slot == slot and r.mix_position in (position, position + 1) and r.mix_release <= slot < r.mix_deadline
    schedule = lambda **given: {(r.mix_source, r.mix_block, r.mix_slot) for r in mixing.mix(docs, block_docs=2, **given).collect()}
    assert schedule() == schedule(slice_slots=1) == schedule(slice_slots=5)  # slices that end with the schedule or before
    monkeypatch.setattr(mixing, "BROADCAST_SLOTS", 0)
    assert sorted(r.mix_position for r in mixing.mix(docs, block_docs=2).collect()) == list(range(len(prose)))
    monkeypatch.undo()
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(docs).count() == len(prose)
    assert mixing.mix(docs.limit(0)).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 1500).alias("source"))
    assert [r.mix_position for r in mixing.mix(many, block_docs=1).select("mix_position").orderBy("mix_position").collect()] == list(range(3000))


def test_mix_stays_within_a_block_of_its_weights():
    for weights in ({"a": 1 / 3, "b": 2 / 3}, {"a": 0.0005, "b": 0.4, "c": 0.5995}, {f"s{i}": 0.5**i for i in range(25)}, {f"s{i}": i**0.5 for i in range(1, 20)}):
        whole = mixing.whole_weights(weights)
        total, done = sum(whole.values()), Counter()
        for slot, (k, j, release, deadline) in zip(range(20_000), mixing.pfair(whole)):
            assert release <= slot < deadline and done[k] == j
            done[k] += 1
            if slot % 97 < 3:
                assert all(abs(done[x] * total - (slot + 1) * whole[x]) < total for x in whole)
    blocks = {"a": 400_000, "b": 200_000, "c": 25_000}  # the blocks of 10 million documents
    whole, done = mixing.whole_weights({"a": 0.5, "b": 0.3, "c": 0.2}), Counter()
    for phase, k, j, slot, release, deadline in mixing.plan(blocks, {"a": 0.5, "b": 0.3, "c": 0.2}):
        assert release <= slot < deadline and done[k] == j
        done[k] += 1
        if phase == 0 and slot % 97 < 3:
            assert all(abs(done[x] * sum(whole.values()) - (slot + 1) * whole[x]) < sum(whole.values()) for x in whole)
    assert done == blocks
    phases = mixing.plan({"a": 10, "b": 3, "c": 0}, {"a": 1.0, "b": 1.0, "c": 1.0})
    assert [(k, j) for _, k, j, *_ in phases] == brute_schedule({"a": 10, "b": 3}, {"a": 1.0, "b": 1.0})


def test_packing(spark, prose):
    texts = [*prose, (80, "word " * 5000), (81, "a b " * 1024), (82, "b\x1cc it's l'eau ΑΣ 12 <|endoftext|>")]
    rows = packing.pack_documents(documents(spark, texts), TOKENIZER).collect()
    whole = Tokenizer.from_file(TOKENIZER)
    assert 49407 in whole.encode(texts[-1][1], add_special_tokens=False).ids
    want = Counter()
    for i, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for n, s in enumerate(range(0, len(ids), 2048)):
            want[i, n, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack_documents(documents(spark, prose).limit(0), TOKENIZER).count() == 0


def test_packed_sequences_follow_the_mix(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(i, "word " * rng.choice([60, 150, 400, 650])) for i in range(600)]
    docs = documents(spark, texts)
    stages, got = dict(corpus_pipeline.STAGES), {}
    for cell_rows in (7, 20_000):
        monkeypatch.setattr(packing, "NUMBERING_CELL_ROWS", cell_rows)
        for first in ("s0", "s1"):
            weights = {"s0": 1.0, "s1": 1.0, "s2": 1.0} | {first: 50.0}
            mixed = materialize(mixing.mixed_documents(docs, weights), "mixed")
            rows = stages["packing"](spark, mixed, "").collect()
            assert "_file" not in rows[0].asDict() and sorted((r.doc_id, r.piece) for r in rows) == sorted((i, 0) for i, _ in texts)
            bins = defaultdict(list)
            for r in rows:
                bins[r.sequence_id].append((r.offset, r.length))
            assert sorted(bins) == list(range(len(bins))) and len(bins) == len({r.sequence_id for r in packing.pack_documents(docs, TOKENIZER).collect()})
            for pieces in bins.values():
                pieces.sort()
                assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 2048
            place = lambda s: np.mean([r.sequence_id for r in rows if r.doc_id % 3 == s and r.doc_id != 5]) / len(bins)
            assert place(int(first[1])) < 0.3 < 0.5 < place(2)
            got[cell_rows, first] = sorted(map(tuple, rows), key=str)
    assert got[7, "s0"] == got[20_000, "s0"] and got[7, "s0"] != got[7, "s1"]


def test_fullest_is_the_best_subset():
    rng = random.Random(6)
    for _ in range(100):
        available = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(0, 60)
        sums = {0}
        for length, n in available.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = packing.fullest(available, room)
        assert sum(k * m for k, m in chosen.items()) == max(s for s in sums if s <= room) and all(m <= available[k] for k, m in chosen.items())


def test_tokens_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_CHUNKS", 3)
    encode = tokens.word_encoder.__wrapped__(TOKENIZER)
    whole = Tokenizer.from_file(TOKENIZER)
    for texts in (["a b c", "Été d'eau."], ["new words here", "a b"], ["", "again, new words"]):
        assert [x.tolist() for x in encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_suffix_tree_scores_do_not_depend_on_partitions(spark):
    """2,100 input partitions give the scores of three; counts of one frequency are added up over many runs of slices."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcde", k=3)) for _ in range(40)]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(2200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    scores = [sorted((r.doc_id, r.n_known, r.train_tokens, round(r.base_score, 7), round(r.score, 7)) for r in suffixtree.score_documents(docs.repartition(n)).collect()) for n in (3, 2100)]
    assert len(scores[0]) == 2200 and scores[0] == scores[1]


def test_suffix_tree_counts_of_many_slices(spark, monkeypatch):
    rng = random.Random(13)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(["a", "b", "c d e", "f g"], k=30)) + f" w{i}") for i in range(50)], "doc_id long, text string").repartition(5)
    want = sorted(map(tuple, suffixtree.score_documents(docs).collect()))
    monkeypatch.setattr(suffixtree, "RUN_SLICES", 2)
    assert sorted(map(tuple, suffixtree.score_documents(docs).collect())) == want
