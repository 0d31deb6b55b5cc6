"""What the two label-trained operators share: a bounded sample of labelled rows, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundmesh.llm.common import materialize

#: Labelled rows that a model is fitted on, at most (about): the bound of every model's size.
TRAIN_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out_mod: int | None, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs joined with ``label`` (as 0 or 1) of at most about ``rows`` labelled ids, chosen by hash; written once, as fits read it often.

    Any label above 0 counts as 1; of several labels of one id, the largest. Copies of a text with one label count once. Rows whose crc32(doc_id as text) is 0 modulo ``held_out_mod`` are never used. The sampled ids are few whatever
    the corpus, so they are broadcast.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if held_out_mod:
        usable = usable.where(F.crc32(F.col("doc_id").cast("long").cast("string")) % held_out_mod != 0)
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("_label"))
    total = usable.count()
    if total > rows:
        usable = usable.where(F.pmod(F.xxhash64("_label_id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * rows / total))
    joined = docs.join(F.broadcast(usable), docs["doc_id"].cast("long") == F.col("_label_id")).drop("_label_id")
    return materialize(joined.withColumn("_copy", F.xxhash64("text")).dropDuplicates(["_copy", "_label"]).drop("_copy"), "sample")


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression, by Newton steps; the intercept is not shrunk."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    penalty = np.full(design.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - penalty * w
        hessian = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w
