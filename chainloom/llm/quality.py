"""Quality by naive Bayes support vectors.

A document's distinct word n-grams and shape n-grams (letter case, last
character, repetition of the word before) are hashed; each indicator is scaled by the
log of the ratio of its smoothed class counts, and a linear hinge-loss model is fitted on the
scaled indicators by dual coordinate descent. A sigmoid fitted on rows kept
apart turns margins into scores.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .labelled import fit_sigmoid, remainder, teaching_sample

LOG_BUCKETS = 20
MIN_DOCS = 4
#: At most so many labelled rows teach.
SAMPLE = 16_384

_upper = np.zeros(256, np.int64)
_upper[65:91] = 1
_lower = np.zeros(256, np.int64)
_lower[97:123] = 1
_last = np.full(256, 3, np.int64)
_last[48:58] = 1
_last[97:123] = _last[65:91] = _last[128:] = 0
_last[[0x2E, 0x2C]] = 2


def grams(column) -> list[np.ndarray]:
    """Per row the distinct buckets of its word 1- and 2-grams and shape 1- to 4-grams."""
    data, offsets = ts.utf8(column)
    starts, ends, first = ts.word_spans(data, offsets, ts.NONSPACE)
    if not len(starts):
        return [np.zeros(0, np.int32) for _ in offsets[1:]]
    words = ts.hash_spans(data, starts, ends)
    upper = np.add.reduceat(_upper[data], starts) if len(data) else starts
    lower = np.add.reduceat(_lower[data], starts)
    case = np.where(upper == 0, 0, np.where(lower > 0, 1, np.where(upper > 1, 2, 3)))
    again = np.append(False, words[1:] == words[:-1])
    again[first[:-1][first[:-1] < len(words)]] = False
    shape = (case * 8 + _last[data[ends - 1]] * 2 + again + 1).astype(np.uint64)
    lists = [(words, 1), (ts.gram_hashes(words, 2), 2)] + [(ts.gram_hashes(shape, k) ^ np.uint64(k), k) for k in range(1, 5)]
    lists = [((h >> np.uint64(64 - LOG_BUCKETS)).astype(np.int32), k) for h, k in lists]
    return [np.unique(np.concatenate([h[a: max(a, b - k + 1)] for h, k in lists])) for a, b in zip(first[:-1], first[1:])]


class Margin:
    def __init__(self, place: np.ndarray, ratio: np.ndarray, w: np.ndarray, sigmoid: np.ndarray):
        self.place, self.ratio, self.w, self.sigmoid = place, ratio, w, sigmoid

    def rows(self, rows: list[np.ndarray]):
        """Kept indicators and their values; a row's values have length one. The last indicator is the bias."""
        for r in rows:
            p = self.place[r]
            p = p[p >= 0]
            x = self.ratio[p]
            yield np.append(p, len(self.ratio) - 1), np.append(x / max(np.sqrt(x @ x), 1e-9), 1.0)

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.w[p] @ x for p, x in self.rows(rows)], float)

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sigmoid[0] * self.margins(rows) + self.sigmoid[1], -30, 30)))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, place=self.place, ratio=self.ratio, w=self.w, sigmoid=self.sigmoid)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Margin:
        with np.load(io.BytesIO(raw)) as f:
            return cls(f["place"], f["ratio"], f["w"], f["sigmoid"])


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, passes: int = 12, seed: int = 7) -> Margin:
    """Log-count ratios from all rows given, then dual coordinate descent on four fifths and the sigmoid on the rest."""
    size = 1 << LOG_BUCKETS
    every = np.concatenate(rows) if rows else np.zeros(0, int)
    owner = np.repeat(y, [len(r) for r in rows]) if rows else np.zeros(0)
    df = np.bincount(every, minlength=size)
    used = np.flatnonzero(df >= MIN_DOCS)
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    prior = np.array([0.0, np.log(rate / (1 - rate))])
    if len(set(y.tolist())) < 2:
        return Margin(place, np.zeros(len(used) + 1), np.zeros(len(used) + 1), prior)
    good, bad = np.bincount(every, owner, size)[used] + 1, np.bincount(every, 1 - owner, size)[used] + 1
    ratio = np.append(np.log(good / good.sum() * bad.sum() / bad), 1.0)
    model = Margin(place, ratio, np.zeros(len(ratio)), prior)
    xs = list(model.rows(rows))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(xs))
    kept, rest = order[len(order) // 5:], order[: len(order) // 5]
    sign = np.where(y > 0, 1.0, -1.0)
    # classes weigh alike, as good documents are most
    bound = np.where(y > 0, cost * 0.5 / rate, cost * 0.5 / (1 - rate))
    alpha, norm, w = np.zeros(len(xs)), np.array([x @ x for _, x in xs]), model.w
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(kept):
            p, x = xs[i]
            new = min(max(alpha[i] - (sign[i] * (w[p] @ x) - 1) / norm[i], 0.0), bound[i])
            if new != alpha[i]:
                w[p] += (new - alpha[i]) * sign[i] * x
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    margins = np.array([w[xs[i][0]] @ xs[i][1] for i in rest])
    model.sigmoid = fit_sigmoid(margins, y[rest], np.array([2.0, prior[1]]))
    return model


def _grams_of(batches):
    for whole in batches:
        for b in ts.slices(whole):
            rows = [r.astype("<i4").tobytes() for r in grams(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(rows, pa.binary())], ["y", "grams"])


def _fit(pdf):
    import pandas as pd
    order = pdf.sort_values(["y", "grams"])  # the same model whatever order the rows arrive in
    model = fit([np.frombuffer(t, "<i4") for t in order["grams"]], order["y"].to_numpy().astype(float))
    return pd.DataFrame({"model": [model.to_bytes()]})


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Margin:
    """Learn from at most ``sample`` labelled rows outside the held-out fifth; that bounded sample is one task's work."""
    ts.small_batches(docs.sparkSession)
    taught = teaching_sample(docs, labels, "quality", 5, 0, sample).mapInArrow(_grams_of, "y int, grams binary")
    got = taught.groupBy(F.lit(1).alias("all")).applyInPandas(_fit, "model binary").collect()
    return Margin.from_bytes(bytes(got[0][0])) if got else fit([], np.zeros(0))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts get the score of no n-gram; equal rows are scored each;
    without labels every score is 0.5. A null doc_id is not held out.
    """
    model = learn(docs, labels, sample)

    def run(batches):
        for whole in batches:
            for b in ts.slices(whole):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(grams(b.column("text"))))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
