"""Quality classifier by hierarchical empirical Bayes.

A document classifier gives each document its evidence: a ridge logistic on shape statistics of the whole text and on the
mean log-odds of its distinct words (with their case and marks), fitted on at most TRAIN_ROWS labelled rows. Word log-odds are smoothed counts of
documents by label; each half of the sample takes its own from the other half, so the logistic weighs them as they
count on unseen texts. Sites are two levels: host and path. By grouped aggregation over all documents,
each host's mean quality is shrunk towards the global mean and each path's mean towards its host's, with prior
strengths estimated from the spread between sites (method of moments). A document's final log-odds are its evidence
plus what its path, itself left out, says beyond the global mean. Sparse sites thus stay near the global prior.

Site sums are partial aggregates (a hot host is one row per task and path) and reach the documents by a broadcast
only while they number at most BROADCAST_SITES rows; beyond, by a shuffled join that AQE can split.

Defined cases: null and empty texts have neutral statistics and their evidence is the intercept's; null hosts or paths
form sites of their own; repeated rows count again; without labels of both kinds the evidence is 0 and everything is
kept; an empty table gives an empty result; extra columns pass through ``filter_documents`` and are else not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundmesh.llm.common import discard, materialize, small
from groundmesh.llm.training import TRAIN_ROWS, labelled_sample, logistic_fit

BROADCAST_SITES = 100_000
#: Weight of the site's log-odds beside the document's evidence.
SITE_WEIGHT = 1.0
#: Log-odds of one document are cut to this before site sums, so that no document outweighs the others.
EVIDENCE_CUT = 8.0
SHAPES = ("repeats", "variety", "symbols", "upper", "bare", "digits", "word_length", "words", "line_repeats", "stops")
FEATURES = (*SHAPES, "words_odds")
#: Documents of the sample that hold a word, at least, for it to count, and the weight of the prior beside its counts.
LEAST_DOCS = 5
PRIOR_DOCS = 4.0
#: Labelled rows whose crc32(doc_id as text) is divisible by this may be kept out of a fit, to measure it.
HELD_OUT_MOD = 5

_LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_PLAIN = _LETTERS + _DIGITS + b" \t\r\n.,;:'\"()-?/@+"
_STOPS = b".,;:?"


def shape(text: str | None) -> tuple[tuple[float, ...], set[bytes]]:
    """Shape statistics of the whole text, each about 0 for plain prose and larger the odder the text; and its distinct words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0.0,) * len(SHAPES), set()
    n, size, distinct = len(words), len(raw), set(words)
    letters = size - len(raw.translate(None, _LETTERS))
    upper = size - len(raw.translate(None, _UPPER))
    digits = size - len(raw.translate(None, _DIGITS))
    symbols = len(raw.translate(None, _PLAIN))
    stops = size - len(raw.translate(None, _STOPS))
    repeats = sum(map(eq, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    bare = words.count(b"|") + words.count(b"-") + words.count(b"*")
    scale = lambda x: float(np.log1p(50 * x))
    return (
        scale(repeats / n),
        max(0.0, 1 - len(distinct) / n - 0.06 * np.log(n)),
        scale(symbols / size),
        scale(upper / (letters + 20)),
        scale(bare / n),
        scale(digits / size),
        abs(float(np.log((letters + 5) / (n + 1)) - 1.6)),
        float(1 / np.sqrt(n)),
        scale(1 - len(set(lines)) / len(lines)),
        scale(stops / size),
    ), distinct


def measured(text: str | None, table: dict[bytes, float]) -> tuple[float, ...]:
    """FEATURES of the text: its shape, and the mean log-odds of its words that the table knows."""
    shapes, words = shape(text)
    known = [table[w] for w in words if w in table]
    return *shapes, sum(known) / (len(known) + 5.0)


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    words: dict[bytes, float]
    prior: float

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([measured(t, self.words) for t in texts]).reshape(-1, len(FEATURES))
        x = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.clip(self.weights[0] + np.column_stack([x, x * x]) @ self.weights[1:], -30, 30)


def word_counts(sample: DataFrame) -> DataFrame:
    """word and good0, bad0, good1, bad1: documents of either half of the sample that hold it, added up inside tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            held: dict[tuple[bytes, int], list[int]] = {}
            for text, label, half in zip(*(batch[c].to_pylist() for c in ("text", "_label", "_half")), strict=True):
                for w in shape(text)[1]:
                    held.setdefault((w, half), [0, 0])[label] += 1
            names = list(held)
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield pa.RecordBatch.from_pydict({"word": pa.array([n[0] for n in part], pa.binary()), "half": pa.array([n[1] for n in part], pa.int32()), "good": [held[n][1] for n in part], "bad": [held[n][0] for n in part]})

    rows = sample.select("text", "_label", "_half").mapInArrow(count, "word binary, half int, good long, bad long")
    of = lambda c, h: F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}")
    return rows.groupBy("word").agg(of("good", 0), of("bad", 0), of("good", 1), of("bad", 1))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, held_out_mod: int | None = None) -> QualityModel:
    """Fit the document classifier on at most about ``rows`` labelled documents (their words and statistics only reach the driver)."""
    sample = labelled_sample(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, "quality", held_out_mod, rows)
    sample = sample.withColumn("_half", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int"))
    sizes = {(r["_half"], r["_label"]): r["n"] for r in sample.groupBy("_half", "_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = lambda halves: (sum(sizes.get((h, 1), 0) for h in halves) + 0.5) / (sum(sizes.get((h, y), 0) for h in halves for y in (0, 1)) + 1)
    tables: list[dict[bytes, float]] = [{}, {}, {}]  # for rows of half 0, of half 1, and of no half
    counted = word_counts(sample).where(F.col("good0") + F.col("bad0") + F.col("good1") + F.col("bad1") >= LEAST_DOCS).collect()  # bounded by the sample
    for r in counted:
        for table, halves in zip(tables, ((1,), (0,), (0, 1)), strict=True):
            good, bad, p = sum(r[f"good{h}"] for h in halves), sum(r[f"bad{h}"] for h in halves), share(halves)
            if good + bad:
                table[bytes(r["word"])] = float(np.log((good + PRIOR_DOCS * p) / (bad + PRIOR_DOCS * (1 - p))) - np.log(p / (1 - p)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            values = [list(measured(t, tables[h])) for t, h in zip(batch["text"].to_pylist(), batch["_half"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch["_label"]], names=["x", "label"])

    got = sample.select("text", "_label", "_half").mapInArrow(measure, "x array<double>, label int").collect()
    y = np.array([r["label"] for r in got], dtype=float)
    k = len(FEATURES)
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros(k), np.ones(k), np.zeros(2 * k + 1), {}, 0.5)
    x = np.array([r["x"] for r in got])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / spread, -6, 6)
    return QualityModel(mean, spread, logistic_fit(np.column_stack([z, z * z]), y), tables[2], float((y.sum() + 0.5) / (len(y) + 1)))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def with_evidence(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with ``_evidence``, the classifier's log-odds: of the column text, which goes, or of the field text of the column row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            text = batch["text"] if "text" in batch.schema.names else pc.struct_field(batch["row"], "text")
            odds = shared.value.log_odds(text.to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(odds, pa.float64())], names=[*names, "_evidence"])

    return docs.mapInArrow(run, docs.select(*names).withColumn("_evidence", F.lit(0.0)).schema)


def site_sums(evidence: DataFrame, host: Column, path: Column) -> DataFrame:
    """_host, _path, n, good, square: documents, summed and squared quality per path."""
    p = 1 / (1 + F.exp(-F.least(F.greatest(F.col("_evidence"), F.lit(-EVIDENCE_CUT)), F.lit(EVIDENCE_CUT))))
    rows = evidence.select(F.coalesce(host.cast("string"), F.lit("\x00")).alias("_host"), F.coalesce(path.cast("string"), F.lit("\x00")).alias("_path"), p.alias("p"))
    return rows.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good"))


def strength(groups: DataFrame, n: str, good: str, towards: Column) -> float:
    """Prior strength (as if so many documents) from the spread of group means around what they shrink to."""
    rate = F.col(good) / F.col(n)
    got = groups.agg(
        F.sum(F.col(n) * (rate - towards) * (rate - towards)).alias("between"),
        F.sum(towards * (1 - towards)).alias("within"),
        F.sum(F.col(n) * towards * (1 - towards)).alias("scale"),
    ).first()
    if not got["scale"]:
        return 1.0
    variance = max(0.0, got["between"] - got["within"]) / got["scale"]  # share of the binomial variance that sites explain
    return min(1e6, max(1.0, 1 / variance - 1 if variance > 0 else 1e6))


def site_posteriors(sums: DataFrame) -> DataFrame:
    """_host, _path, n, good, host_mean, path_prior (strength), global_mean: every level shrunk towards the one above."""
    total = sums.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = min(1 - 1e-4, max(1e-4, (total["good"] or 0.0) / (total["n"] or 1)))
    hosts = sums.groupBy("_host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    k_host = strength(hosts, "host_n", "host_good", F.lit(overall))
    hosts = hosts.withColumn("host_mean", (F.col("host_good") + k_host * overall) / (F.col("host_n") + k_host))
    both = sums.join(hosts, "_host")
    k_path = strength(both, "n", "good", F.col("host_mean"))
    return both.select("_host", "_path", "n", "good", "host_mean", F.lit(k_path).alias("path_prior"), F.lit(overall).alias("global_mean"))


def decide(evidence: DataFrame, sites: DataFrame, host: Column, path: Column, weight: float = SITE_WEIGHT) -> DataFrame:
    """Add host_mean, path_mean, doc_score, score and keep to rows with ``_evidence``."""
    named = evidence.withColumn("_host", F.coalesce(host.cast("string"), F.lit("\x00"))).withColumn("_path", F.coalesce(path.cast("string"), F.lit("\x00")))
    small = sites.count() <= BROADCAST_SITES
    own = 1 / (1 + F.exp(-F.least(F.greatest(F.col("_evidence"), F.lit(-EVIDENCE_CUT)), F.lit(EVIDENCE_CUT))))
    path_mean = (F.greatest(F.col("good") - own, F.lit(0.0)) + F.col("path_prior") * F.col("host_mean")) / (F.col("n") - 1 + F.col("path_prior"))
    bounded = F.least(F.greatest(F.col("path_mean"), F.lit(1e-4)), F.lit(1 - 1e-4))
    joined = named.join(F.broadcast(sites) if small else sites, ["_host", "_path"])
    odds = F.col("_evidence") + weight * (logit(bounded) - logit(F.col("global_mean")))
    out = joined.withColumn("path_mean", path_mean).withColumn("doc_score", 1 / (1 + F.exp(-F.col("_evidence")))).withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.withColumn("keep", F.col("score") >= 0.5)


def score_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", held_out_mod: int | None = None) -> DataFrame:
    """doc_id, host, path, doc_score, host_mean, path_mean, score, keep of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.concat_ws("/", F.col(host), F.col(path)).alias("path"), F.col("text").cast("string").alias("text"))
    rows = materialize(with_evidence(docs, fit(docs, labels, held_out_mod=held_out_mod)), "evidence")
    sites = materialize(site_posteriors(site_sums(rows, F.col("host"), F.col("path"))), "sites")
    return decide(rows, sites, F.col("host"), F.col("path")).select("doc_id", "host", "path", "doc_score", "host_mean", "path_mean", "score", "keep")


def filter_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of docs, all columns kept, that the classifier keeps. Texts are scanned twice, for the sites and for the decision, and written never."""
    model = fit(docs, labels)
    sites_of = [F.col(host).cast("string").alias("host"), F.concat_ws("/", F.col(host), F.col(path)).alias("path")]
    evidence = materialize(with_evidence(docs.select(F.col("text").cast("string").alias("text"), *sites_of), model), "evidence")
    sites = materialize(site_posteriors(site_sums(evidence, F.col("host"), F.col("path"))), "sites")
    discard(evidence)
    kept = decide(with_evidence(docs.select(F.struct(*docs.columns).alias("row"), *sites_of), model), sites, F.col("host"), F.col("path")).where("keep")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
