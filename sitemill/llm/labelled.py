"""A bounded sample of labelled documents, for fitting."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemill.session import materialise


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where: Column | None = None) -> DataFrame:
    """Written table (doc_id, text, y): about ``rows`` rows for each of the labels 0 and 1 at most.

    A label's rows are taken by a hash of doc_id, as large a share of all as the bound allows,
    so a run on the same table takes the same rows. The sample's ids are what is broadcast;
    texts are not shuffled. Null labels and null doc_ids are left out; of repeated label rows
    for one doc_id the larger label counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.where(where) if where is not None else known
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    taken = None
    for y, n in sorted(counts.items()):
        part = known.where((F.col("y") == y) & (share < rows / n))
        taken = part if taken is None else taken.unionByName(part)
    taken = known.limit(0) if taken is None else taken
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialise(texts.join(F.broadcast(taken), "doc_id"), "labelled")  # at most about 2 * rows ids


def logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients of P(y = 1) = 1 / (1 + exp(-x @ beta)) by damped Newton steps.

    Rows are weighed so that ``prior`` of their weight has y = 1, as in the table that they were drawn from.
    """
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    s = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        h = (x * (s * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (s * (y - p)) - ridge * beta)
        beta = beta + step * min(1.0, 2.0 / max(abs(step).max(), 1e-12))
        if abs(step).max() < 1e-8:
            break
    return beta
