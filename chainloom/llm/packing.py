"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of tokens. Queues are served in quanta of a fixed number
of tokens; a queue's j-th quantum is due at time ``j / weight``, and quanta go
out in order of that time. This is what a deficit round-robin with carried
deficits does: in every window a queue gets its share to within a quantum, and
what it got too little of stays due in the next. As the order is a formula, the
place of a quantum is the sum of what all queues have had by then, and every
task finds the places of its own documents from the queues' totals alone: the
deficits carry over windows and partitions without a pass through one task.
A queue that runs dry leaves its share to the others.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import textscan as ts

WEIGHT_STEPS = 1_000_000
KEPT_UNITS = 2_000_000


#: Beside an ASCII letter these always end a pre-token; the apostrophe (contractions) and the bar (special tokens) do not.
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in '!"#$%&()*+,-./:;=?@[]^_`{}~']] = True
#: First bytes of the characters above ASCII that count as white space.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Encoder:
    """Token ids of whole texts, each distinct piece between safe cuts tokenized once.

    A byte-level BPE never merges across pre-tokens. A pre-token always begins
    at a single space between other characters, on both sides of a single line
    feed, and between an ASCII letter and a mark, so texts can be cut there and
    the ids joined again. Known pieces are a sorted table of hashes with places
    in one array of ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 20, np.uint16)
        self.used = 0

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        sizes, ids = [], []
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            got = e.ids
            sizes.append(len(got))
            ids += got
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used: self.used + len(ids)] = ids
        size = np.array(sizes, np.int64)
        begin = self.used + np.cumsum(size) - size
        self.used += len(ids)
        at = np.searchsorted(self.known, hashes)
        self.known, self.begin, self.size = (np.insert(x, at, y) for x, y in ((self.known, hashes), (self.begin, begin), (self.size, size)))

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row)."""
        data, offsets = ts.utf8(column)
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(rows, np.int64)
        plain, letter, mark = ts.NONSPACE[data], _LETTER[data], _MARK[data]
        # white space that stands alone inside one row; what follows must not begin a non-ASCII space either
        alone = np.zeros(len(data), bool)
        alone[1:-1] = ~plain[1:-1] & plain[:-2] & plain[2:] & ~_MAYBE_SPACE[data[2:]]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        alone[edge] = alone[edge - 1] = False
        feed = alone & (data == 0x0A)
        cut = (alone & (data == 0x20)) | feed
        cut[1:] |= feed[:-1] | (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
        cut[edge] = cut[0] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        unique, index, back = np.unique(ts.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > KEPT_UNITS:
            self.clear()
        at = np.minimum(np.searchsorted(self.known, unique), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[at] != unique) if len(self.known) else np.arange(len(unique))
        if len(new):
            raw = data.tobytes()
            self.learn(unique[new], [raw[s:e].decode() for s, e in zip(starts[index[new]].tolist(), ends[index[new]].tolist())])
            at = np.searchsorted(self.known, unique)
        begin, n = self.begin[at][back], self.size[at][back]
        out = np.concatenate(([0], np.cumsum(n)))
        ids = self.pool[np.arange(out[-1]) + np.repeat(begin - out[:-1], n)]
        row_first = np.searchsorted(starts, offsets)
        return ids, out[row_first[1:]] - out[row_first[:-1]]


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One per worker process, so that its table serves all its tasks."""
    return Encoder(path)


def _tokenize(path: str, end_id: int):
    def run(batches):
        encoder = encoder_of(path)
        had: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for whole in batches:
            for b in ts.slices(whole):
                ids, n = encoder.encode(b.column("text"))
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
                edges = np.concatenate(([0], np.cumsum(n)))
                at = []
                for q, x in zip(b.column("queue").to_pylist(), n.tolist()):
                    at.append(had.get(q, 0))
                    had[q] = at[-1] + x
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((edges * 2).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("source"), b.column("queue"), pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), raw],
                    ["doc_id", "source", "queue", "part", "at", "doc_tokens", "ids"])
    return run


class Schedule:
    """Where each quantum of each queue begins in the one stream of all windows."""

    def __init__(self, totals: dict[int, int], weights: dict[int, int], quantum: int):
        self.queues = sorted(totals)
        self.index = {q: i for i, q in enumerate(self.queues)}
        self.total = np.array([totals[q] for q in self.queues], np.int64)
        self.weight = np.array([weights[q] for q in self.queues], np.int64)
        self.quantum = quantum

    def begin(self, queue: int, j: np.ndarray) -> np.ndarray:
        """Stream position of quanta j of a queue: the tokens of every quantum due before it."""
        me = self.index[queue]
        out = np.zeros(len(j), np.int64)
        for i in range(len(self.queues)):
            due = j * self.weight[i]
            # quanta x of queue i with x / weight_i < j / weight_me; of equal times the lower queue is first
            count = due // self.weight[me] + 1 if i < me else -(-due // self.weight[me])
            out += np.minimum(self.total[i], count * self.quantum)
        return out


def _cut(totals, weights, quantum: int, length: int):
    def run(batches):
        plan = Schedule(totals, weights, quantum)
        for b in batches:
            out = {c: [] for c in ("row", "start", "length", "crc", "sequence_id", "offset")}
            for row, (q, base, at, n, raw) in enumerate(zip(*(b.column(c).to_pylist() for c in ("queue", "base", "at", "doc_tokens", "ids")))):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                x = base + at
                j = np.arange(x // quantum, (x + n - 1) // quantum + 1)
                begin = plan.begin(q, j)
                begin[0] += x - j[0] * quantum
                size = np.full(len(j), quantum, np.int64)
                size[0] = (j[0] + 1) * quantum - x
                size[-1] -= (j[-1] + 1) * quantum - (x + n)
                joined = np.concatenate(([True], begin[1:] != begin[:-1] + size[:-1]))
                first = np.flatnonzero(joined)
                begin, size, start = begin[first], np.add.reduceat(size, first), 0
                for p, s in zip(begin.tolist(), size.tolist()):
                    while s:
                        take = min(s, length - p % length)
                        out["row"].append(row)
                        out["start"].append(start)
                        out["length"].append(take)
                        out["crc"].append(zlib.crc32(ids[start: start + take].tobytes()))
                        out["sequence_id"].append(p // length)
                        out["offset"].append(p % length)
                        start, p, s = start + take, p + take, s - take
            row = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(row), b.column("source").take(row), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64()),
                 b.column("doc_tokens").take(row), pa.array(out["sequence_id"], pa.int64()), pa.array(out["offset"], pa.int64())],
                ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, tokenizer: str | None = None, targets: dict[str, float] | None = None, length: int = 2048, quantum: int = 128, end_id: int = 1) -> DataFrame:
    """Pieces of documents that fill sequences of ``length`` tokens in the target proportions.

    ``targets`` maps sources to token shares; without it, and for sources it does
    not name, the shares are those of the documents themselves, so that all
    queues end together. Returns doc_id, source, start, length, ids_crc32,
    doc_tokens, sequence_id and offset, one row per piece; every token is in one
    piece, and only the last sequence is not full. A null or empty text is its
    end token alone; a null source is a queue; equal rows are packed each. Ids
    must be below 65536.
    """
    spark = docs.sparkSession
    ts.small_batches(spark)
    # every source has a queue of its own, the null source too
    sources = stored(ts.with_row_id(docs.select("source").distinct().orderBy("source"), "queue"), "sources")
    kind = dict(docs.dtypes)
    tokens = stored(
        docs.select("doc_id", "source", "text").join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
        .mapInArrow(_tokenize(tokenizer or default_tokenizer(), end_id),
                    f"doc_id {kind['doc_id']}, source {kind['source']}, queue long, part int, at long, doc_tokens long, ids binary"), "tokens")
    parts = tokens.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per queue and task of the pass above; small enough for Spark to send whole, or else joined by shuffle
    bases = stored(parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))), "bases")
    totals = {r[0]: int(r[1]) for r in bases.groupBy("queue").agg(F.sum("n")).collect()}  # a row per source
    whole = sum(totals.values()) or 1
    share = {q: t / whole for q, t in totals.items()}
    if targets:
        named = sources.select("queue", F.col("source").cast("string").alias("name")).filter(F.col("name").isin(sorted(targets))).collect()
        share.update({r["queue"]: targets[r["name"]] for r in named if r["queue"] in totals})
    weights = {q: max(1, round(WEIGHT_STEPS * s)) for q, s in share.items()}
    return tokens.join(bases.drop("n"), ["queue", "part"]).mapInArrow(
        _cut(totals, weights, quantum, length),
        f"doc_id {kind['doc_id']}, source {kind['source']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
