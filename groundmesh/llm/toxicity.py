"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme-value theory.

Nodes are words and their prefixes. For each node, documents of either label that hold it are counted, and its
log-odds get an informative Dirichlet prior (the pooled rate, at PRIOR times the sample): ratio and standard error as
in Monroe, Colaresi and Quinn (2008). A node counts where its ratio lies SIGNIFICANT errors off 0, whatever the share of toxic labels. A word that
JUDGED_DOCS documents of the sample hold is judged by itself: it scores its own log-odds if it counts, else a small negative
background. Any other word scores the highest node above 0 that counts among itself and its prefixes, else the background. In every text a linear scan
(Ruzzo and Tompa 1999) finds all maximal scoring segments; those above the extreme-value threshold of Karlin and
Altschul (1990) count as toxic passages. lambda is solved from the scores of clean training tokens; K is not their infinite
sum but its first term, the limit for rare hits. The segments' summed score, less the log of the search space, goes through a logistic
curve fitted on the training rows.

Labels are learnt from at most TRAIN_ROWS rows, so the model is bounded whatever the corpus. Scores use the text only.

Defined cases: null and empty texts have no segments and get the curve's lowest score; without labels, or without toxic
ones, no node is significant and every score is the smoothed share of toxic labels; repeated rows score alike; a null
doc_id is carried; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmesh.llm.common import materialize, small
from groundmesh.llm.training import TRAIN_ROWS, labelled_sample, logistic_fit

PREFIXES = range(3, 9)
PRIOR = 0.1
SIGNIFICANT = 4.0
LEAST_BACKGROUND = 0.05
#: Documents of the sample from which on a word is judged by itself.
JUDGED_DOCS = 20
HELD_OUT_MOD = 5
#: Chance of one such segment in a clean text, at most, for a segment to count as a passage.
PASSAGE_CHANCE = 0.05
KEPT_WORDS = 300_000
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def nodes_of(words: set[str]) -> set[str]:
    """Full words (marked with a trailing blank) and prefixes."""
    found = {w + " " for w in words}
    for n in PREFIXES:
        found.update(w[:n] for w in words if len(w) >= n)
    return found


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), in linear time; runs of one sign enter the scan as one."""
    if not len(scores) or scores.max() <= 0:
        return []
    positive = scores > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], positive, [False]]).astype(np.int8)))
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # each candidate: begin, end, cumulative score left of it, cumulative score at its end
    stack: list[tuple[int, int, float, float]] = []
    lefts: list[int] = []  # for each on the stack: the nearest one before it with a smaller left score, or -1
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        left, right = float(total[begin]), float(total[end])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = lefts[j]
            if j < 0 or stack[j][3] >= right:
                stack.append((begin, end, left, right))
                lefts.append(j)
                break
            begin, left = stack[j][0], stack[j][2]
            del stack[j:], lefts[j:]
    return [(b, e, r - x) for b, e, x, r in stack]


@dataclass
class ToxicityModel:
    nodes: dict[str, float]
    background: float
    rate: float  # lambda of the extreme-value law
    space: float  # K
    curve: tuple[float, float]  # intercept and slope
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def token_score(self, word: str) -> float:
        best = self.nodes.get(word + " ")
        if best is None or best > 0:
            best = max([best or 0.0, *(self.nodes.get(word[:n], 0.0) for n in PREFIXES if n <= len(word))])
        return best if best > 0 else min(best, -self.background)

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """Significant segments as (first word, end, score), and the number of words."""
        words = words_of(text)
        if not self.nodes or not words:
            return [], len(words)
        memo = self.memo
        if len(memo) > KEPT_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self.token_score(w)
        scores = np.fromiter(map(memo.__getitem__, words), dtype=np.float64, count=len(words))
        least = math.log(max(1.0, self.space * len(words) / PASSAGE_CHANCE)) / self.rate
        return [s for s in maximal_segments(scores) if s[2] >= least], len(words)

    def evidence(self, segments: list[tuple[int, int, float]], words: int) -> float:
        """Summed normalised score: rate * sum of segments, less the log of the search space."""
        return max(0.0, self.rate * sum(s for _, _, s in segments) - math.log(1 + self.space * words)) if segments else 0.0

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] + self.curve[1] * math.log1p(evidence)))))


def node_counts(sample: DataFrame) -> DataFrame:
    """node, toxic, clean: documents of the sample that hold it, summed inside tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            held: dict[str, list[int]] = {}
            for text, label in zip(batch["text"].to_pylist(), batch["_label"].to_pylist(), strict=True):
                for node in nodes_of(set(words_of(text))):
                    held.setdefault(node, [0, 0])[label] += 1
            names = list(held)
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield pa.RecordBatch.from_pydict({"node": part, "toxic": [held[n][1] for n in part], "clean": [held[n][0] for n in part]})

    rows = sample.select("text", "_label").mapInArrow(count, "node string, toxic long, clean long")
    return rows.groupBy("node").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, held_out_mod: int | None = HELD_OUT_MOD) -> ToxicityModel:
    """Learn nodes, background, extreme-value law and curve from at most about ``rows`` labelled documents."""
    spark = docs.sparkSession
    sample = labelled_sample(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, "toxic", held_out_mod, rows)
    sizes = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    share = (toxic + 0.5) / (toxic + clean + 2)  # below a half without labels
    nothing = ToxicityModel({}, LEAST_BACKGROUND, 1.0, 1.0, (math.log(share / (1 - share)), 0.0))
    if not toxic or not clean:
        return nothing
    pseudo = PRIOR * (F.col("toxic") + F.col("clean"))
    whole = PRIOR * (toxic + clean)
    odds = lambda n, of: F.log((n + pseudo) / (of - n + whole - pseudo + 0.5))
    ratio = odds(F.col("toxic"), toxic) - odds(F.col("clean"), clean)
    error = F.sqrt(1 / (F.col("toxic") + pseudo) + 1 / (F.col("clean") + pseudo))
    known = node_counts(sample).where(F.col("toxic") + F.col("clean") >= 2).withColumn("ratio", ratio).withColumn("counts", F.abs("ratio") >= SIGNIFICANT * error)
    known = materialize(known, "nodes")
    nodes = {r["node"]: r["ratio"] for r in known.where("counts").select("node", "ratio").collect()}  # bounded by the sample
    # words judged by themselves that do not count matter where a prefix of theirs counts; they score no more than 0
    above = spark.createDataFrame([(n,) for n in nodes if not n.endswith(" ")], "above string")
    begun = F.explode(F.array(*(F.substring("node", 1, n) for n in PREFIXES)))
    judged = known.where("NOT counts AND endswith(node, ' ')").where(F.col("toxic") + F.col("clean") >= JUDGED_DOCS)
    nodes |= {r["node"]: 0.0 for r in judged.select("node", begun.alias("above")).join(F.broadcast(above), "above", "left_semi").select("node").distinct().collect()}
    if not any(x > 0 for x in nodes.values()):
        return nothing
    model = ToxicityModel(nodes, LEAST_BACKGROUND, 1.0, 1.0, (0.0, 0.0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            seen: dict[tuple[int, float], int] = {}
            for text, label in zip(batch["text"].to_pylist(), batch["_label"].to_pylist(), strict=True):
                for w, n in Counter(words_of(text)).items():
                    at = label, round(model.token_score(w), 2)
                    seen[at] = seen.get(at, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.float64()), pa.array(list(seen.values()), pa.int64())], names=["label", "score", "n"])

    seen = sample.select("text", "_label").mapInArrow(measure, "label long, score double, n long").groupBy("label", "score").agg(F.sum("n").alias("n")).collect()  # a row per label and score of two digits
    hits, words = ({k: sum(r["n"] for r in seen if r["label"] == k and (r["score"] > 0 or every)) for k in (0, 1)} for every in (False, True))
    chance = {k: (hits[k] + 0.5) / (words[k] + 1.0) for k in (0, 1)}
    model.background = max(LEAST_BACKGROUND, -math.log((1 - chance[1]) / (1 - chance[0])))
    clean = {r["score"] if abs(r["score"]) > LEAST_BACKGROUND else -model.background: r["n"] for r in seen if r["label"] == 0}
    gain = sum(r["score"] * r["n"] for r in seen if r["score"] > 0) / max(1, hits[0] + hits[1]) or max(nodes.values())
    clean[gain] = clean.get(gain, 0) + 0.5  # a hit is possible even where none was seen
    model.rate, model.space = extreme_value_law(clean)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [model.evidence(*model.passages(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch["_label"]], names=["evidence", "label"])

    pairs = sample.select("text", "_label").mapInArrow(evidence, "evidence double, label int").collect()  # a number a sampled row
    x, y = np.array([[math.log1p(r["evidence"])] for r in pairs]), np.array([r["label"] for r in pairs], dtype=float)
    a, b = logistic_fit(x, y, ridge=0.1)
    model.curve = (float(a), max(0.0, float(b)))
    return model


def extreme_value_law(counts: dict[float, float]) -> tuple[float, float]:
    """lambda and K of clean tokens with the given scores: lambda solves sum of p(s) * e^(lambda * s) = 1 over scores s.

    K is taken at the rare-hit limit, the sum of p(s) * e^(lambda * s) over hits: one hit then has the chance of one hit in the text.
    """
    total = sum(counts.values())
    s, p = np.array(list(counts)), np.array(list(counts.values())) / total
    low, high = 1e-6, 50.0
    balance = lambda r: float((p * np.exp(np.minimum(700.0, r * s))).sum()) - 1
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if balance(middle) < 0 else (low, middle)
    return low, float((p * np.exp(np.minimum(700.0, low * s)))[s > 0].sum())


SCORES = "doc_id long, held_out boolean, score double, predicted int, evidence double, n_passages long, passages array<struct<start:long,end:long,score:double>>"


def score(docs: DataFrame, model: ToxicityModel, held_out_mod: int = HELD_OUT_MOD) -> DataFrame:
    """One row per document: score, predicted, and every significant passage by its words."""
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small(batches):
            rows = []
            for text in batch["text"].to_pylist():
                segments, words = model.passages(text)
                x = model.evidence(segments, words)
                p = model.probability(x)
                rows.append((p, int(p >= 0.5), x, len(segments), [{"start": b, "end": e, "score": s} for b, e, s in segments]))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.float64(), pa.int32(), pa.float64(), pa.int64(), pa.list_(passage)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "held_out", "score", "predicted", "evidence", "n_passages", "passages"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % held_out_mod == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORES)


def clean_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs, all columns kept, whose text the model does not predict to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small(batches):
            keep = [model.probability(model.evidence(*model.passages(t))) < 0.5 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
