"""Licence scan by a positional rare-token index over licence texts.

The templates (texts, citations and tags of ``license_texts``, or any others given) are indexed by word: word -> (template,
place in it). Document frequencies of the template words are counted over all documents first: they say which words are rare, so where
a file is looked up. What a word weighs in a template does not depend on the table: its IDF among the templates. For each file, its licence words are
looked up from the highest IDF down; each template takes the first ANCHORS of them that it holds. A posting of a word at
place p, met at position i of the file, puts the template's start at i - p. The postings are intersected by relative position: where at least
half of the anchors (two at least, if it has two) agree on a start within a slack of a tenth of the template, its region is
verified: every mandatory key phrase must stand in it word for word, and the words it shares with the template must hold at least LEAST_MASS
of the template's mass. That share is the score. Of regions that overlap by half, the one with the most mass gives its label.

Base phrases are templates of their own: their rarest word is looked up, and every place where the phrase stands counts.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.

Defined cases: null and empty texts have no words, no labels and score 0; very long texts are scanned whole; repeated
rows are scanned again; a null doc_id is carried; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmesh.llm.common import small
from groundmesh.llm.license_texts import CITATIONS, REFERENCES, SPDX, TEXTS

#: Base phrases and their labels. They count wherever their words stand consecutively.
BASE_PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}
#: Share of a template's mass that a region must hold.
LEAST_MASS = 0.5
#: A file's rarest words that place a template.
ANCHORS = 8
SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,words:long,score:double>>"

_SEPARATOR = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
FOLD = bytes(0x20 if b in set(_SEPARATOR) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 bytes: separators are ASCII, so folding bytes equals folding characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    base: bool
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]


def template(label: str, text: str, keys: list[str] | None = None, base: bool = False) -> Template:
    words = tuple(words_of(text))
    return Template(label, base, words, tuple(tuple(words_of(k)) for k in keys) if keys else (words,))


def templates() -> list[Template]:
    """The base phrases and the default templates."""
    own = [template(k, text, keys) for k, (text, keys) in TEXTS.items()] + [template(k, v) for k, v in CITATIONS.items()]
    own += [template(k, text, keys) for k, text, keys in REFERENCES]
    tags = [template(f"spdx-{k.lower()}", f"SPDX-License-Identifier: {k}") for k in SPDX]
    return [template(k, v, base=True) for k, v in BASE_PHRASES.items()] + own + tags


def word_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each template word occurs, and the number of documents. One row a task and word at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {"": 0}
        for batch in small(batches):
            seen[""] += batch.num_rows
            for text in batch["text"]:
                for w in vocabulary.intersection(words_of(text.as_py())):
                    seen[w.decode()] = seen.get(w.decode(), 0) + 1
        yield pa.RecordBatch.from_pydict({"word": list(seen), "n": pa.array(list(seen.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a template word
    found = {r["word"]: r["n"] for r in rows}
    return {w: found.get(w.decode(), 0) for w in vocabulary}, found.get("", 0)


class RareTokenIndex:
    """Postings of template words, the lookup from a file's rarest words down, and the verification of regions."""

    def __init__(self, found: list[Template], idf: dict[bytes, float]) -> None:
        self.templates, self.idf = found, idf
        self.counts = [Counter(t.words) for t in found]
        holders = Counter(w for t in found for w in set(t.words))
        self.weight = {w: math.log((len(found) + 1) / (n + 1)) + 1e-3 for w, n in holders.items()}
        self.mass = [sum(self.weight[w] for w in t.words) for t in found]
        self.slack = [0 if t.keys == (t.words,) else max(2, len(t.words) // 10) for t in found]
        self.keys = [frozenset(w for key in t.keys for w in key) for t in found]
        self.needed = frozenset(max(t.words, key=lambda w: (idf[w], w)) if t.base else max(k, key=lambda w: (idf[w], w)) for t, k in zip(found, self.keys, strict=True))
        self.postings: dict[bytes, dict[int, list[int]]] = {}
        for n, t in enumerate(found):
            for p, w in enumerate(t.words):
                self.postings.setdefault(w, {}).setdefault(n, []).append(p)
        self.vocabulary = frozenset(self.postings)

    def anchors(self, present: frozenset[bytes]) -> dict[int, list[bytes]]:
        """For every template whose key words are all there: the file's rarest words that it holds, highest IDF first."""
        found: dict[int, list[bytes]] = {}
        for w in sorted(present, key=lambda w: (-self.idf[w], w)):
            for n in self.postings[w]:
                if self.keys[n] <= present:
                    held = found.setdefault(n, [])
                    if len(held) < (1 if self.templates[n].base else ANCHORS):
                        held.append(w)
        return found

    def regions(self, n: int, words: list[bytes], anchors: list[bytes], at: dict[bytes, np.ndarray]) -> list[tuple[int, int]]:
        """(begin, end) in the file where enough anchors agree on the template's start within the slack."""
        starts = [(at[w][:, None] - np.array(self.postings[w][n])).ravel() for w in anchors]
        which = np.repeat(np.arange(len(anchors)), [len(x) for x in starts])
        start = np.concatenate(starts)
        order = np.argsort(start, kind="stable")
        start, which = start[order], which[order]
        slack, least = self.slack[n], min(len(anchors), max(2, -(-len(anchors) // 2)))
        out: list[list[int]] = []
        seen, low = Counter(), 0
        for high in range(len(start)):
            seen[which[high]] += 1
            while start[high] - start[low] > slack:
                seen[which[low]] -= 1
                if not seen[which[low]]:
                    del seen[which[low]]
                low += 1
            if len(seen) >= least:
                begin, end = int(start[low]), int(start[high]) + len(self.templates[n].words) + slack
                if out and begin <= out[-1][1] - len(self.templates[n].words):
                    out[-1][1] = end
                else:
                    out.append([begin, end])
        return [(max(0, b - slack), min(e, len(words))) for b, e in out]

    def verify(self, n: int, words: list[bytes], begin: int, end: int) -> tuple[int, int, float] | None:
        """First and last word that the region shares with the template, and the share of its mass, if its key phrases stand there."""
        part = words[begin:end]
        if not all(has_phrase(part, key) for key in self.templates[n].keys):
            return None
        shared = self.counts[n] & Counter(part)
        share = sum(self.weight[w] * m for w, m in shared.items()) / self.mass[n]
        if share < LEAST_MASS:
            return None
        inside = [i for i, w in enumerate(part, begin) if w in self.counts[n]]
        return inside[0], inside[-1] + 1, min(1.0, share)

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float, list[tuple[str, int, int, float]]]:
        """Starts of base phrases, base labels, all labels, best score and the spans of the method's own templates."""
        base_at, base, found = [], set(), []
        present = self.vocabulary.intersection(words)
        if present.isdisjoint(self.needed):
            return [], set(), set(), 0.0, []
        anchors = self.anchors(present)
        wanted = {w for held in anchors.values() for w in held}
        places: dict[bytes, list[int]] = {w: [] for w in wanted}
        for i, w in enumerate(words):
            if w in wanted:
                places[w].append(i)
        at = {w: np.array(p) for w, p in places.items()}
        for n, held in anchors.items():
            t = self.templates[n]
            if t.base:
                starts = [i - p for i in places[held[0]] for p in self.postings[held[0]][n] if i >= p and tuple(words[i - p : i - p + len(t.words)]) == t.words]
                base_at += starts
                base |= {t.label} if starts else set()
                continue
            for begin, end in self.regions(n, words, held, at):
                if got := self.verify(n, words, begin, end):
                    found.append((got[2] * self.mass[n], t.label, *got))
        spans: list[tuple[str, int, int, float]] = []
        for _, label, begin, end, share in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if all(2 * (min(end, b + size) - max(begin, b)) <= min(end - begin, size) for _, b, size, _ in spans):
                spans.append((label, begin, end - begin, share))
        best = 1.0 if base else max((s[3] for s in spans), default=0.0)
        return base_at, base, {s[0] for s in spans} | base, best, sorted(spans, key=lambda s: (s[1], s[0]))


def has_phrase(words: list[bytes], phrase: tuple[bytes, ...]) -> bool:
    size, first = len(phrase), phrase[0]
    return any(words[i] == first and tuple(words[i : i + size]) == phrase for i in range(len(words) - size + 1))


def scan_licenses(docs: DataFrame, found: list[Template] | None = None) -> DataFrame:
    """One row per document: counts and places of base phrases, labels, best score and the method's spans (by ``templates()`` unless others are given)."""
    found = found or templates()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vocabulary = frozenset(w for t in found for w in t.words)
    counts, total = word_frequencies(docs, vocabulary)
    idf = {w: math.log((total + 1) / (n + 1)) + 1e-3 for w, n in counts.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RareTokenIndex(found, idf)
        for batch in small(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                words = words_of(text.as_py())
                at, base, labels, score, spans = index.scan(words)
                rows.append((doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [dict(zip(("label", "start", "words", "score"), s, strict=True)) for s in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
    return docs.mapInArrow(scan, SCAN)
