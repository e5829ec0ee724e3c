"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words, hashed to buckets and weighted by
how rare they are. A linear weight and a short vector are learnt for each
bucket; the vectors' products are weights of pairs, so that two terms that are
harmless alone can count together. A term is learnt if its own share of toxic
documents is off the mean, or if it belongs to a pair whose documents the
single terms leave unexplained. Learning sees a bounded sample of labelled
rows, scoring runs where the documents are.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .labelled import fit_sigmoid, remainder, teaching_sample

LOG_BUCKETS = 18
FACTORS = 6
#: A term or a pair of terms is evidence if its toxic documents differ from what is expected by so many standard errors.
MIN_DEVIATION = 6.0
#: Fewer sample rows than this are no evidence.
MIN_DOCS = 8
#: Pairs are counted in so many slots before they are counted exactly.
LOG_SLOTS = 24
#: At most so many labelled rows teach.
SAMPLE = 16_384


def terms(column) -> list[np.ndarray]:
    """Per row the distinct buckets of its words."""
    raw, offsets = ts.utf8(column)
    data = ts.LOWER[raw]
    starts, ends, first = ts.word_spans(data, offsets, ts.ALNUM)
    buckets = (ts.hash_spans(data, starts, ends) >> np.uint64(64 - LOG_BUCKETS)).astype(np.int32)
    return [np.unique(buckets[a:b]) for a, b in zip(first[:-1], first[1:])]


class Machine:
    """Bucket 0 of the kept terms is the bias: every document has it."""

    def __init__(self, place: np.ndarray, x: np.ndarray, w: np.ndarray, v: np.ndarray, sigmoid=(1.0, 0.0)):
        self.place, self.x, self.w, self.v, self.sigmoid = place, x, w, v, np.asarray(sigmoid)

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        kept = [self.place[r] for r in rows]
        kept = [np.append(0, p[p > 0]) for p in kept]
        if not kept:
            return np.zeros(0)
        return _forward(np.concatenate(kept), np.cumsum([0] + [len(p) for p in kept])[:-1], self.x, self.w, self.v)[0]

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sigmoid[0] * self.margins(rows) + self.sigmoid[1], -30, 30)))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, place=self.place, x=self.x, w=self.w, v=self.v, sigmoid=self.sigmoid)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Machine:
        with np.load(io.BytesIO(raw)) as f:
            return cls(f["place"], f["x"], f["w"], f["v"], f["sigmoid"])


def _forward(a, begin, x, w, v):
    xa = x[a]
    va = v[a] * xa[:, None]
    s = np.add.reduceat(va, begin)
    q = np.add.reduceat(va * va, begin)
    return np.add.reduceat(w[a] * xa, begin) + 0.5 * (s * s - q).sum(1), xa, va, s


def _pairs_of(terms: np.ndarray):
    """The pairs (smaller, larger) of a sorted set as single numbers, in blocks of bounded size."""
    wide = terms.astype(np.int64)
    at = 0
    while at < len(wide) - 1:
        some = max(1, (1 << 20) // (len(wide) - at))
        left = np.arange(at, min(at + some, len(wide) - 1))
        sizes = len(wide) - 1 - left
        right = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(left + 1, sizes)
        yield (np.repeat(wide[left], sizes) << LOG_BUCKETS) | wide[right]
        at += some


def _slot(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - LOG_SLOTS)).astype(np.int64)


def paired_terms(rows: list[np.ndarray], y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Terms of the pairs that occur in toxic rows more often than the chances ``p`` of the single terms explain.

    A pair is looked at if enough rows hold it that are toxic with a chance
    below one half; it counts by a score test over all rows that hold it.
    """
    missed = [rows[i] for i in np.flatnonzero((y > 0) & (p < 0.5))]
    counts = np.zeros(1 << LOG_SLOTS, np.int32)
    for r in missed:
        for pairs in _pairs_of(r):
            np.add.at(counts, _slot(pairs), 1)
    often = counts >= MIN_DOCS
    if not often.any():
        return np.zeros(0, np.int64)
    found = np.zeros(0, np.int64)
    for r in missed:
        for pairs in _pairs_of(r):
            found = np.union1d(found, pairs[often[_slot(pairs)]])
    of_pair = np.zeros(1 << LOG_BUCKETS, bool)
    of_pair[found >> LOG_BUCKETS] = of_pair[found & ((1 << LOG_BUCKETS) - 1)] = True
    n, off, spread = np.zeros(len(found)), np.zeros(len(found)), np.zeros(len(found))
    for r, left, chance in zip(rows, y - p, p):
        for pairs in _pairs_of(r[of_pair[r]]):
            pairs = pairs[often[_slot(pairs)]]
            at = np.minimum(np.searchsorted(found, pairs), len(found) - 1)
            at = at[found[at] == pairs]
            n[at] += 1
            off[at] += left
            spread[at] += chance * (1 - chance)
    told = found[(n >= MIN_DOCS) & (off >= MIN_DEVIATION * np.sqrt(spread + 1e-9))]
    return np.union1d(told >> LOG_BUCKETS, told & ((1 << LOG_BUCKETS) - 1))


def fit(rows: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Machine:
    """A machine over the terms that tell by themselves, then, if pairs tell more, over those and the terms of the pairs."""
    every = np.concatenate(rows) if rows else np.zeros(0, int)
    df = np.bincount(every, minlength=1 << LOG_BUCKETS)
    toxic = np.bincount(every, np.repeat(y, [len(r) for r in rows]) if rows else None, 1 << LOG_BUCKETS)
    rate = (y.sum() + 1) / (len(y) + 2)
    used = np.flatnonzero((df >= MIN_DOCS) & (np.abs(toxic - df * rate) >= MIN_DEVIATION * np.sqrt(df * rate * (1 - rate))))
    model = _descend(rows, y, df, used, seed)
    if len(set(y.tolist())) < 2:
        return model
    told = np.union1d(used, paired_terms(rows, y, model.score(rows)))
    return _descend(rows, y, df, told, seed) if len(told) > len(used) else model


def _descend(rows, y, df, used, seed, passes: int = 20, step: float = 0.15) -> Machine:
    """Logistic loss by adaptive gradient steps over small batches of four fifths of the rows; the rest fit the sigmoid."""
    rng = np.random.default_rng(seed)
    rate = (y.sum() + 1) / (len(y) + 2)
    place = np.zeros(1 << LOG_BUCKETS, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    n = max(2, len(rows))
    x = np.concatenate(([1.0], 0.5 + 0.5 * np.log(n / df[used]) / np.log(n)))
    w, v = np.zeros(len(x)), rng.normal(0, 0.05, (len(x), FACTORS))
    v[0] = 0
    w[0] = np.log(rate / (1 - rate))
    if len(set(y.tolist())) < 2:
        return Machine(place, x, w, v * 0)
    kept = [np.append(0, p[p > 0]) for p in (place[r] for r in rows)]
    gw, gv = np.full(len(w), 1e-8), np.full(v.shape, 1e-8)
    split = rng.permutation(len(kept))
    mine, rest = split[len(split) // 5:], split[: len(split) // 5]
    for _ in range(passes):
        order = rng.permutation(mine)
        for at in range(0, len(order), 128):
            take = order[at: at + 128]
            sizes = np.array([len(kept[i]) for i in take])
            a = np.concatenate([kept[i] for i in take])
            z, xa, va, s = _forward(a, np.cumsum(sizes) - sizes, x, w, v)
            g = np.repeat((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) / len(take), sizes) * xa
            seen, back = np.unique(a, return_inverse=True)
            d = np.bincount(back, g)
            gw[seen] += d * d
            w[seen] -= step * d / np.sqrt(gw[seen])
            s = np.repeat(s, sizes, 0)
            for f in range(FACTORS):
                d = np.bincount(back, g * (s[:, f] - va[:, f])) * (seen > 0)
                gv[seen, f] += d * d
                v[seen, f] -= step / 3 * d / np.sqrt(gv[seen, f])
    model = Machine(place, x, w, v)
    model.sigmoid = fit_sigmoid(model.margins([rows[i] for i in rest]), y[rest], np.array([1.0, 0.0]))
    return model


def _terms_of(batches):
    for whole in batches:
        for b in ts.slices(whole):
            rows = [r.astype("<i4").tobytes() for r in terms(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(rows, pa.binary())], ["y", "terms"])


def _fit(pdf):
    import pandas as pd
    order = pdf.sort_values(["y", "terms"])  # the same model whatever order the rows arrive in
    model = fit([np.frombuffer(t, "<i4") for t in order["terms"]], order["y"].to_numpy().astype(float))
    return pd.DataFrame({"model": [model.to_bytes()]})


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Learn from at most ``sample`` labelled rows outside the held-out third; that bounded sample is one task's work."""
    ts.small_batches(docs.sparkSession)
    taught = teaching_sample(docs, labels, "toxic", 3, 1, sample).mapInArrow(_terms_of, "y int, terms binary")
    got = taught.groupBy(F.lit(1).alias("all")).applyInPandas(_fit, "model binary").collect()
    return Machine.from_bytes(bytes(got[0][0])) if got else fit([], np.zeros(0))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc (the input row), doc_id, held_out, score and predicted of every document.

    Null and empty texts get the score of no term; equal rows are scored each;
    without labels every score is 0.5. A null doc_id is not held out.
    """
    model = learn(docs, labels, sample)

    def run(batches):
        for whole in batches:
            for b in ts.slices_of(whole, lambda t: t.column("doc").field("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(model.score(terms(b.column("doc").field("text"))))], ["doc", "score"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    scored = packed.mapInArrow(run, f"doc {packed.schema['doc'].dataType.simpleString()}, score double")
    return scored.select("doc", F.col("doc.doc_id").alias("doc_id"), (remainder(F.col("doc.doc_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The input rows that are not predicted toxic."""
    return toxicity(docs, labels, **how).filter("predicted = 0").select("doc.*")
