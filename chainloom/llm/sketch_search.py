"""Ranked lexical search over hashed max-sketches.

The impact of a term in a document grows with its occurrences, so a document is
folded into a few rows of coordinates: each term goes to one coordinate of every
row, and a coordinate keeps the largest number of occurrences that fell on it. A
query term's impact is then at most that of the smallest of its coordinates.
Lookups for a whole batch of queries give an upper bound of every document's
score; documents are rescored exactly on their texts in descending order of that
bound until no bound reaches the score of the last place. The sketches are as
wide as their documents have distinct terms, so long texts stay as sharp as
short ones, and one written table holds sketches beside texts: bounds read the
sketches only, and rescoring needs no join.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import textscan as ts

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Rows of coordinates, coordinates per distinct term (rounded up to a power of two) and the most in a row.
ROWS, SPREAD, WIDEST = 3, 2, 1 << 20
#: An entry that reads 255 stands for any larger number of occurrences.
FULL = 255
#: Bits of a term's hash kept while it is counted; two terms that agree in them only add up, which keeps a bound a bound.
TERM_BITS = 44
#: Bounds are added up in pieces of at most this many (document, term, query) entries.
ENTRIES = 1 << 21
#: Queries whose bounds are held at a time.
QUERY_BLOCK = 1024


def terms(text: str | None) -> list[str]:
    """The terms of a text, in order and with repeats."""
    return TERM.findall((text or "").translate(LOW))


def impact(tf, m):
    """What ``tf`` occurrences in a document of relative length ``m`` count, per unit of a term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _places(term: np.ndarray, width: np.ndarray | int, row: int) -> np.ndarray:
    """The coordinate of a term in one row of a sketch."""
    mask = np.asarray(width).astype(np.uint64) - np.uint64(1)
    return (ts.mix(term * np.uint64(ts.BASE) + np.uint64(row)) & mask).astype(np.int64)


def _folded(text: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(terms per row, sketch per row, row and hash of every term)."""
    data, offsets = ts.utf8(text)
    starts, ends, first = ts.word_spans(data := ts.LOWER[data], offsets, ts.ALNUM)
    n = first[1:] - first[:-1]
    row = np.repeat(np.arange(len(n)), n).astype(np.uint64)
    hashes = ts.hash_spans(data, starts, ends)
    shift = np.uint64(TERM_BITS)
    row_bits = np.uint64(64 - TERM_BITS)
    assert len(n) < 1 << int(row_bits)
    key, tf = np.unique((row << shift) | (hashes >> row_bits), return_counts=True)
    owner = (key >> shift).astype(np.int64)
    distinct = np.bincount(owner, minlength=len(n))
    width = np.minimum(WIDEST, 1 << np.ceil(np.log2(np.maximum(1, SPREAD * distinct))).astype(np.int64))
    width[distinct == 0] = 0
    begin = np.concatenate(([0], np.cumsum(ROWS * width)))
    sketch = np.zeros(begin[-1], np.uint8)
    kept = np.minimum(tf, FULL).astype(np.uint8)
    term = key & np.uint64((1 << TERM_BITS) - 1)
    for r in range(ROWS):
        np.maximum.at(sketch, begin[owner] + r * width[owner] + _places(term, width[owner], r), kept)
    raw = sketch.tobytes()
    return n, [raw[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())], row, hashes


def _index(vocabulary: np.ndarray):
    """Documents with their sketches, and after a task's last document one row that holds how many of them have each query term."""
    def run(batches):
        df = np.zeros(len(vocabulary), np.int64)
        schema = None
        for whole in batches:
            for b in ts.slices(whole):
                n, sketches, row, hashes = _folded(b.column("text"))
                if len(vocabulary):
                    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                    known = vocabulary[at] == hashes
                    held = np.unique(row[known].astype(np.int64) * len(vocabulary) + at[known])
                    df += np.bincount(held % len(vocabulary), minlength=len(vocabulary))
                nulls = pa.nulls(b.num_rows, pa.binary())
                out = pa.RecordBatch.from_arrays(
                    [b.column("_row"), b.column("doc_id"), b.column("text"), pa.array(n, pa.int64()), pa.array(sketches, pa.binary()), nulls],
                    ["_row", "doc_id", "text", "n", "sketch", "df"])
                schema = out.schema
                yield out
        if schema is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, schema.field(i).type) for i in range(5)] + [pa.array([df.tobytes()], pa.binary())], schema=schema)
    return run


class Queries:
    """A block of queries: the documents' totals, and each term's weight in each query, repeats included."""

    def __init__(self, texts: list[str | None], df: dict[str, int], documents: int, length: int):
        self.documents, self.length = documents, max(1, length)
        asked = [Counter(terms(t)) for t in texts]
        # a term that no document holds adds nothing to any score
        self.terms = sorted({t for q in asked for t in q if df.get(t)})
        self.code = {t: i for i, t in enumerate(self.terms)}
        self.hashes = term_hashes(self.terms) >> np.uint64(64 - TERM_BITS)
        self.size = len(texts)
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) for t in self.terms]
        posts = sorted((self.code[t], q, k * weight[self.code[t]]) for q, c in enumerate(asked) for t, k in c.items() if t in self.code)
        code, query, w = (np.array(x, np.int64) for x in (zip(*posts) if posts else ((), (), ())))
        self.first = np.searchsorted(code, np.arange(len(self.terms) + 1))
        self.query, self.weight = query, w
        self._places: dict[int, np.ndarray] = {}

    def places(self, width: int) -> np.ndarray:
        """Coordinates of all terms in all rows of a sketch of that width."""
        if width not in self._places:
            self._places[width] = np.stack([_places(self.hashes, width, r) + r * width for r in range(ROWS)])
        return self._places[width]

    def m(self, n):
        return 25 + (75 * n * self.documents) // self.length

    def _add(self, out: np.ndarray, doc: np.ndarray, code: np.ndarray, value: np.ndarray) -> None:
        many = self.first[code + 1] - self.first[code]
        total, a = np.cumsum(many), 0
        while a < len(many):
            b = max(a + 1, int(np.searchsorted(total, total[a] - many[a] + ENTRIES, "right")))
            k = many[a:b]
            post = np.arange(k.sum()) + np.repeat(self.first[code[a:b]] - (np.cumsum(k) - k), k)
            # every sum stays far below 2 ** 53, so adding doubles is exact
            out += np.bincount(np.repeat(doc[a:b], k) * self.size + self.query[post], np.repeat(value[a:b], k) * self.weight[post], len(out)).astype(np.int64)
            a = b

    def bounds(self, n: np.ndarray, sketches: list[bytes]) -> np.ndarray:
        """Upper bounds, documents x queries."""
        out = np.zeros(len(n) * self.size, np.int64)
        sizes = np.array([len(s) for s in sketches], np.int64)
        for size in np.unique(sizes[sizes > 0]).tolist() if len(self.terms) else []:
            docs = np.flatnonzero(sizes == size)
            at = self.places(size // ROWS)
            step = max(1, ENTRIES // at.shape[1])
            for k in range(0, len(docs), step):
                some = docs[k: k + step]
                table = np.frombuffer(b"".join([sketches[i] for i in some]), np.uint8).reshape(len(some), size)
                tf = table[:, at[0]]
                for r in range(1, ROWS):
                    tf = np.minimum(tf, table[:, at[r]])
                doc, code = np.nonzero(tf)
                held = tf[doc, code].astype(np.int64)
                value = np.where(held == FULL, 1_000_000, impact(held, self.m(n[some])[doc]))
                self._add(out, some[doc], code, value)
        return out.reshape(len(n), self.size)

    def scores(self, n: np.ndarray, texts: list[str]) -> np.ndarray:
        """Exact scores, documents x queries."""
        out = np.zeros(len(n) * self.size, np.int64)
        doc, code, tf = [], [], []
        for i, text in enumerate(texts):
            for t, k in Counter(terms(text)).items():
                if (c := self.code.get(t)) is not None:
                    doc.append(i)
                    code.append(c)
                    tf.append(k)
        if doc:
            doc, code, tf = (np.array(x, np.int64) for x in (doc, code, tf))
            self._add(out, doc, code, impact(tf, self.m(n)[doc]))
        return out.reshape(len(n), self.size)


def term_hashes(of: list[str]) -> np.ndarray:
    raw = [t.encode() for t in of]
    ends = np.cumsum([len(r) for r in raw]).astype(np.int64) if raw else np.zeros(0, np.int64)
    starts = ends - np.array([len(r) for r in raw], np.int64)
    return ts.hash_spans(np.frombuffer(b"".join(raw), np.uint8), starts, ends)


def _numbers(b: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    return b.column("n").to_numpy(zero_copy_only=False).astype(np.int64), b.column("sketch").to_pylist()


def _leaders(queries: Queries, most: int):
    """Of a task's documents the ``most`` with the largest bounds for each query."""
    def run(batches):
        rows, best = np.zeros((0, queries.size), np.int64), np.zeros((0, queries.size), np.int64)
        for b in batches:
            bound = queries.bounds(*_numbers(b))
            row = np.repeat(b.column("_row").to_numpy(zero_copy_only=False)[:, None], queries.size, 1)
            best, rows = np.concatenate((best, bound)), np.concatenate((rows, row))
            if len(best) > most:
                top = np.argpartition(-best, most - 1, axis=0)[:most]
                best, rows = np.take_along_axis(best, top, 0), np.take_along_axis(rows, top, 0)
        at, q = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(rows[at, q]), pa.array(best[at, q])], ["query", "_row", "bound"])
    return run


def _exact(queries: Queries):
    """Exact scores of the queries that a document leads."""
    def run(batches):
        for b in batches:
            score = queries.scores(b.column("n").to_numpy(zero_copy_only=False).astype(np.int64), b.column("text").to_pylist())
            asked = b.column("queries")
            doc = np.repeat(np.arange(b.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
            q = asked.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(score[doc, q])], ["query", "score"])
    return run


def _best(queries: Queries, floor: np.ndarray, k: int, chunk: int = 32):
    """A task's k best documents of each query, rescored in descending order of their bounds down to the threshold."""
    def run(batches):
        least = np.maximum(floor, 1)
        held = [[] for _ in range(queries.size)]  # (-score, no id, id, row) of the best so far
        for b in batches:
            n, sketches = _numbers(b)
            bound = queries.bounds(n, sketches)
            ids, rows, texts = b.column("doc_id").to_pylist(), b.column("_row").to_pylist(), b.column("text")
            # documents by the largest excess of a bound over its threshold; a document is read once for all queries it may serve
            left = np.flatnonzero((bound >= least).any(axis=1))
            left = left[np.argsort(-(bound[left] / least).max(axis=1), kind="stable")] if len(left) else left
            while len(left):
                some, left = left[:chunk], left[chunk:]
                score = queries.scores(n[some], texts.take(pa.array(some)).to_pylist())
                doc, q = np.nonzero(score >= least)
                for i, j in zip(doc.tolist(), q.tolist()):
                    at = int(some[i])
                    held[j].append((-int(score[i, j]), ids[at] is None, ids[at] if ids[at] is not None else 0, rows[at]))
                for j in np.unique(q).tolist():
                    held[j] = sorted(held[j])[:k]
                    if len(held[j]) == k:
                        least[j] = max(least[j], -held[j][-1][0])
                left = left[(bound[left] >= least).any(axis=1)]
        flat = [(j, None if none else d, -s, r) for j, best in enumerate(held) for s, none, d, r in best]
        query, ids, score, row = zip(*flat) if flat else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64()), pa.array(row, pa.int64())], ["query", "doc_id", "score", "_row"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, leaders: int = 32) -> DataFrame:
    """The k documents with the highest scores above 0 for each item, with ranks from 1.

    Terms are the runs of letters, digits and non-ASCII characters, only A-Z
    lower-cased. Returns item_id, rank, doc_id and score; equal scores go by
    ascending doc_id, documents without an id last. Null and empty texts have no
    terms and are found for nothing; an item without terms finds nothing; equal
    rows are documents or items of their own; a null item_id is an item. Other
    columns are not read. ``doc_id`` and ``item_id`` are integers. The items are
    the stated query set: their terms go to every task, and their bounds are held
    in blocks of 1,024 items, each block reading the sketches twice. How many
    documents hold a term is counted by its 64-bit hash.
    """
    spark = docs.sparkSession
    ts.small_batches(spark)
    asked = [(r["item_id"], r["text"]) for r in items.select("item_id", "text").collect()]  # the query set itself
    vocabulary = sorted({t for _, text in asked for t in terms(text)})
    hashes = term_hashes(vocabulary)
    order = np.argsort(hashes)
    index = stored(
        ts.with_row_id(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).select("_row", "doc_id", "text")
        .mapInArrow(_index(hashes[order]), "_row long, doc_id long, text string, n long, sketch binary, df binary"), "sketches")
    totals = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("length")).first()
    counts = (  # the tasks' counts, added up by place; at most one number per query term comes back
        index.filter("df is not null").select("df").mapInArrow(_counted, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")))
    df = {vocabulary[int(order[r["place"]])]: r["n"] for r in counts.collect()}
    index = index.filter("n is not null").drop("df")
    out = None
    for begin in range(0, max(1, len(asked)), QUERY_BLOCK):
        block = asked[begin: begin + QUERY_BLOCK]
        part = _ranked(index, Queries([t for _, t in block], df, totals["docs"], totals["length"] or 0), k, max(k, leaders))
        ids = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "query long, item_id long")
        part = part.join(ids, "query").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("item_id", F.col("item_id").cast(dict(items.dtypes)["item_id"])).withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))


def _counted(batches):
    for b in batches:
        for raw in b.column("df").to_pylist():
            df = np.frombuffer(raw, np.int64)
            place = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(df[place])], ["place", "n"])


def _ranked(index: DataFrame, queries: Queries, k: int, leaders: int) -> DataFrame:
    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "_row")
    first = (
        index.select("_row", "n", "sketch").mapInArrow(_leaders(queries, leaders), "query long, _row long, bound long")
        .withColumn("at", F.row_number().over(by_bound)).filter(F.col("at") <= leaders)
        .groupBy("_row").agg(F.collect_list("query").alias("queries")))
    # the k-th exact score among the leaders: no document below it can be among the k best
    known = index.select("_row", "n", "text").join(first, "_row").select("n", "text", "queries").mapInArrow(_exact(queries), "query long, score long")
    last = known.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("at") == k)
    floor = np.ones(queries.size, np.int64)
    for r in last.collect():  # a number per query
        floor[r["query"]] = max(1, r["score"])
    best = index.mapInArrow(_best(queries, floor, k), "query long, doc_id long, score long, _row long")
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "_row")
    return best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query", "rank", "doc_id", "score")
