"""Whole results against plain versions: licence labels, toxicity scores, site posteriors, the pipeline, broken archives."""

import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from test_operators import TOKENIZER, brute_components, brute_schedule, documents, labelled_corpus
from tokenizers import Tokenizer

from groundmesh.llm import license_texts, licenses, neardup, quality, toxicity, warc
from groundmesh.llm.common import discard, materialize


def test_licence_texts_are_found_where_base_phrases_are_not(spark):
    rng = random.Random(2)
    noise = ["lorem", "ipsum", "software", "copyright", "notice", "the", "of", "any", "permission", "license", "version"]
    filler = lambda n: " ".join(rng.choices(noise, k=n))
    texts, want = [], {}
    for n, (label, (text, keys)) in enumerate(license_texts.TEXTS.items()):
        words, key_words = text.split(), set(" ".join(keys).split())
        changed = [w if rng.random() > 0.05 or licenses.words_of(w)[:1] == [] or licenses.words_of(w)[0].decode() in key_words else "altered" for w in words]
        texts.append((n, f"{filler(300)} {' '.join(changed)} {filler(200)}"))
        want[n] = label
        shuffled = words[:]
        rng.shuffle(shuffled)
        texts.append((1000 + n, f"{filler(50)} {' '.join(shuffled)}"))
    texts += [(5000, "SPDX-License-Identifier: BSD-3-Clause"), (5001, "word " * 300_000 + license_texts.TEXTS["isc"][0]), (5002, filler(4000))]
    rows = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    for n, label in want.items():
        assert label in rows[n].labels.split(","), (label, rows[n].labels)
        span = next(s for s in rows[n].spans if s.label == label)
        size = len(licenses.words_of(license_texts.TEXTS[label][0]))  # the slack lets filler words in at both ends
        assert min(span.start + span.words, 300 + size) - max(span.start, 300) > 0.8 * size and span.words < 1.6 * size + 8 and span.score >= licenses.LEAST_MASS
        assert label not in rows[1000 + n].labels.split(",")
    assert rows[5000].labels == "spdx-bsd-3-clause" and "isc" in rows[5001].labels.split(",") and rows[5001].spans[0].start == 300_000
    assert rows[5002].labels == "" and rows[5002].score == 0
    own = {want[n] for n in want if not rows[n].base_labels}
    assert len(own) > 10  # labels that no base phrase gives
    few = licenses.scan_licenses(documents(spark, [(1, "a house rule of ours")]), [licenses.template("ours", "house rule of ours")]).first()
    assert few.labels == "ours"


def test_a_licence_label_does_not_depend_on_the_other_documents(spark):
    short = {
        "This work is under the Creative Commons Attribution 4.0 International License.": "cc-by-4.0-text",
        "GNU General Public License as published by the Free Software Foundation version 3": "gpl-3.0",
        "Apache 2.0 licensed": "apache-2.0",
        "Licence MIT": "mit-release",
        "distributed under GPLv2": "gpl-2.0",
    }
    texts = list(enumerate(short))
    others = [(100 + i, "the licence of this work is a matter of its own creative author") for i in range(200)]
    alone = [licenses.scan_licenses(documents(spark, [t])).first() for t in texts]
    among = sorted(licenses.scan_licenses(documents(spark, texts + others)).where("doc_id < 100").collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.labels, r.score) for r in alone] == [(r.doc_id, r.labels, r.score) for r in among]
    for r, label in zip(among, short.values(), strict=True):
        assert label in r.labels.split(","), r


def all_maximal(scores):
    """Maximal scoring segments by their definition: the best segment, then the same left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    total = np.concatenate([[0], np.cumsum(scores)])
    value, _, minus, end = max((total[j] - total[i], i - j, -i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
    begin = -minus
    right = [(a + end, b + end, s) for a, b, s in all_maximal(scores[end:])]
    return [*all_maximal(scores[:begin]), (begin, end, value), *right]


def test_toxicity_by_brute_force(spark):
    rows, labels = labelled_corpus()
    docs = documents(spark, [*rows, (9000, None), (None, "vileword"), (9002, "plain text " * 100_000 + "vileword nastything vileword")])
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (1, 1, 7)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert got[9002].predicted == 1 and got[9002].passages[-1].start == 200_000 and got[None].predicted == 1
    for i, text in rows[:150]:
        words = toxicity.words_of(text)
        scores = []
        for w in words:
            own = model.nodes.get(w + " ")
            prefixes = [model.nodes.get(w[:n], 0.0) for n in range(3, min(8, len(w)) + 1)]
            best = max([own or 0.0, *prefixes]) if own is None or own > 0 else own
            scores.append(best if best > 0 else min(best, -model.background))
        least = math.log(max(1.0, model.space * len(words) / toxicity.PASSAGE_CHANCE)) / model.rate
        found = [x for x in all_maximal(scores) if x[2] >= least]
        x = max(0.0, model.rate * sum(s for *_, s in found) - math.log(1 + model.space * len(words))) if found else 0.0
        p = 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * math.log1p(x))))
        assert got[i].score == pytest.approx(p) and [(r.start, r.end) for r in got[i].passages] == [(a, b) for a, b, _ in found]


def test_site_posteriors_by_brute_force(spark):
    rows, labels = labelled_corpus()
    docs = documents(spark, [*rows, (9000, None), (None, "x"), (9001, "word " * 200_000)])
    got = quality.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    cut = lambda r: 1 / (1 + math.exp(-min(8.0, max(-8.0, math.log(r.doc_score / (1 - r.doc_score))))))
    paths, hosts = defaultdict(list), defaultdict(list)
    for r in got:
        paths[r.host, r.path].append(cut(r))
        hosts[r.host].append(cut(r))
    overall = min(1 - 1e-4, max(1e-4, sum(map(sum, hosts.values())) / len(got)))

    def strength(groups):
        between, within, scale = (sum(f(v, to) for v, to in groups) for f in (lambda v, to: len(v) * (sum(v) / len(v) - to) ** 2, lambda v, to: to * (1 - to), lambda v, to: len(v) * to * (1 - to)))
        variance = max(0.0, between - within) / scale
        return min(1e6, max(1.0, 1 / variance - 1 if variance > 0 else 1e6))

    k = strength([(v, overall) for v in hosts.values()])
    host_mean = {h: (sum(v) + k * overall) / (len(v) + k) for h, v in hosts.items()}
    kp = strength([(v, host_mean[h]) for (h, _), v in paths.items()])
    odds = lambda p: math.log(p / (1 - p))
    for r in got:
        v = paths[r.host, r.path]
        mean = (max(0.0, sum(v) - cut(r)) + kp * host_mean[r.host]) / (len(v) - 1 + kp)
        score = 1 / (1 + math.exp(-(odds(r.doc_score) + odds(min(1 - 1e-4, max(1e-4, mean))) - odds(overall))))
        assert r.score == pytest.approx(score, rel=1e-6) and r.keep == (r.score >= 0.5)


def test_pipeline_by_brute_force(spark, tmp_path):
    rows, labels = labelled_corpus()
    rows = [(i, t.lower() if i % 50 == 0 else t) for i, t in rows] + [(2000 + i, t + " end") for i, t in rows[40:90]] + [(3000, ""), (3001, None)]
    docs = documents(spark, rows).drop("_evidence", "keep")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id for r in quality.score_documents(now, marks).collect() if r.keep}
    now = materialize(corpus_pipeline.keep_quality(spark, now, str(tmp_path)), "t")
    assert {r.doc_id for r in now.collect()} == kept and now.columns == docs.columns
    clean = {r.doc_id for r in toxicity.score(now, toxicity.fit(now, marks)).collect() if not r.predicted}
    texts = [(i, t) for i, t in rows if i in clean]
    first = brute_components(texts)[0]
    left = {i for i in first if first[i] == i}
    assert len(left) < len(clean) < len(kept) < len(rows)
    sources = Counter(f"s{i % 3}" if i != 5 else None for i in left)
    place = {}
    counts = {(k or "\x00"): n for k, n in sources.items()}
    for slot, (k, block) in enumerate(brute_schedule({k: -(-n // 16) for k, n in counts.items()}, {k: n**0.5 for k, n in counts.items()})):
        place[k, block] = slot
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, t in texts:
        if i in left:
            ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
            for n, s in enumerate(range(0, len(ids), 2048)):
                want[i, n, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 2048
    assert sorted(bins) == list(range(len(bins))) and len(bins) <= -(-sum(r.length for r in packed) // 2048) + 1


def test_near_duplicates_of_long_texts(spark):
    words = [f"w{i}" for i in range(60_000)]
    texts = [(1, " ".join(words)), (2, " ".join(words[:-3000])), (3, " ".join(words[:40_000])), (4, "x " * 50_000), (4, "y z " * 9)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert got == {(1, 59_996): 1, (2, 56_996): 1, (3, 39_996): 3, (4, 1): 4, (4, 2): 4}


def test_archives_with_a_changed_byte(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i} {'word ' * i}</p>") for i in range(40)], "page_id long, url string, html string")
    archive = bytes(warc.write_archives(warc.plan_records(pages)).first().content)
    whole = list(warc.iterate_archive(archive))
    rng = random.Random(1)
    for at in rng.sample(range(len(archive)), 120):
        broken = bytearray(archive)
        broken[at] ^= 1 << rng.randrange(8)
        try:
            same = list(warc.iterate_archive(bytes(broken))) == whole
        except Exception:  # noqa: BLE001 any layer may notice
            same = True
        assert same, at


def test_discarded_tables_are_gone(spark):
    table = materialize(spark.range(5), "gone")
    files = table.inputFiles()
    discard(table)
    assert files and all(not __import__("os").path.exists(f.removeprefix("file://")) for f in files)
