"""What both classifiers share: who may teach, and a bounded sample of labelled texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored


def remainder(doc_id: Column, of: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)), F.lit(-1))


def teaching_sample(docs: DataFrame, labels: DataFrame, label: str, of: int, held: int, rows: int) -> DataFrame:
    """(doc_id, text, y): at most ``rows`` labelled documents whose remainder is not ``held``, chosen by a hash of doc_id.

    Labels and ids that are null teach nothing; of several labels of one id the
    larger counts, of several texts the smallest.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null")
        .filter(remainder(F.col("doc_id"), of) != held).groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    chosen = stored(chosen, "teachers")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def fit_sigmoid(margins: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(slope, shift) of the sigmoid that turns margins into chances; ``start`` where the rows hold one class only."""
    if len(set(y.tolist())) < 2:
        return start
    at = start.copy()
    for _ in range(60):  # damped Newton steps on two numbers
        p = 1 / (1 + np.exp(-np.clip(at[0] * margins + at[1], -30, 30)))
        gradient = np.array([((p - y) * margins).sum(), (p - y).sum()]) + 0.01 * (at - start)
        h = p * (1 - p)
        hessian = np.array([[(h * margins * margins).sum() + 0.01, (h * margins).sum()], [(h * margins).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(hessian, gradient)
        at = at - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return at
