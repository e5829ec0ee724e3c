"""Benchmark decontamination by winnowing.

Of every ``window - k + 1`` consecutive k-grams the one with the smallest hash
is kept, on both sides by the same rule, so texts that share ``window`` words
share a kept k-gram. Kept k-grams of the benchmark set bits of a map of fixed
size; documents send on only k-grams whose bit is set, each with the few words
around it. They are joined with the benchmark's and extended to whole windows
by comparing the words themselves, so neither hash nor bit collisions show.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import textscan as ts

MARK = "array<struct<h:bigint,size:int,pos:int,lead:int,words:string>>"
MARK_TYPE = pa.list_(pa.struct([("h", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("lead", pa.int32()), ("words", pa.string())]))


def winnow(grams: np.ndarray, whole: np.ndarray, rows: np.ndarray, span: int) -> np.ndarray:
    """Positions whose hash is the smallest (the last of equals) of some ``span`` consecutive positions of one row.

    ``whole`` lists the positions that hold a k-gram and ``rows`` the row of each.
    """
    n = len(whole) - span + 1
    if n <= 0:
        return whole[:0]
    values = grams[whole]
    best, at = values[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        v = values[j: j + n]
        low = v <= best
        best[low] = v[low]
        at[low] = j
    ok = rows[:n] == rows[span - 1:]
    kept = np.zeros(len(whole), bool)
    kept[(np.arange(n) + at)[ok]] = True
    return whole[kept]


class Scanner:
    """What one batch of texts has of kept k-grams."""

    def __init__(self, column, window: int, k: int):
        raw, offsets = ts.utf8(column)
        self.data = ts.LOWER[raw]
        self.starts, self.ends, self.first = ts.word_spans(self.data, offsets, ts.ALNUM)
        self.words = ts.hash_spans(self.data, self.starts, self.ends)
        self.window, self.k = window, k

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        grams = ts.gram_hashes(self.words, self.k)
        whole = ts.whole_grams(self.first, self.k)
        rows = np.searchsorted(self.first, whole, "right") - 1
        at = winnow(grams, whole, rows, self.window - self.k + 1)
        return at, grams[at] if len(at) else np.zeros(0, np.uint64)

    def exactly(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = ts.whole_grams(self.first, size)
        return at, ts.gram_hashes(self.words, size)[at] if len(at) else np.zeros(0, np.uint64)

    def mark(self, row: int, at: int, h: np.uint64, size: int) -> dict:
        """The k-gram with every word that a window around it can hold."""
        whole = size == self.window
        begin = max(self.first[row], at - (self.window - self.k)) if whole else at
        end = min(self.first[row + 1], at + size)
        text = " ".join(self.data[self.starts[i]: self.ends[i]].tobytes().decode() for i in range(begin, end))
        return {"h": int(h.view(np.int64)), "size": size, "pos": int(at - self.first[row]), "lead": int(at - begin), "words": text}


def _items(window: int, k: int):
    def run(batches):
        for whole in batches:
            for b in ts.slices(whole):
                s = Scanner(b.column("text"), window, k)
                out = [[] for _ in range(b.num_rows)]
                at, h = s.kept()
                for row, p, x in zip(np.searchsorted(s.first, at, "right") - 1, at, h):
                    out[row].append(s.mark(row, p, x, window))
                for row in range(b.num_rows):
                    n = int(s.first[row + 1] - s.first[row])
                    if 0 < n < window:
                        p = s.first[row]
                        out[row].append(s.mark(row, p, ts.gram_hashes(s.words[p: p + n], n)[0], n))
                yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(out, MARK_TYPE)], ["item_id", "marks"])
    return run


def _docs(window: int, k: int, bits: np.ndarray, mask: int, short: list[int], keep: list[str]):
    def run(batches):
        for whole in batches:
            for b in ts.slices_of(whole, lambda t: t.column("doc").field("text")):
                s = Scanner(b.column("doc").field("text"), window, k)
                out = [[] for _ in range(b.num_rows)]
                for size, (at, h) in [(window, s.kept())] + [(n, s.exactly(n)) for n in short]:
                    slot = h & np.uint64(mask)
                    hit = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    at, h = at[hit], h[hit]
                    for row, p, x in zip(np.searchsorted(s.first, at, "right") - 1, at, h):
                        out[row].append(s.mark(row, p, x, size))
                n = pa.array((s.first[1:] - s.first[:-1]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("doc"), n, pa.array(out, MARK_TYPE)], ["doc", "n_words", "marks"])
    return run


def bit_map(hashes: DataFrame, log_bits: int) -> np.ndarray:
    """One bit per hash, ``2 ** log_bits`` bits however many hashes there are; at most that many over 64 rows come to the driver."""
    slot = F.col("h").bitwiseAND(F.lit((1 << log_bits) - 1))
    words = (
        hashes.select(F.shiftrightunsigned(slot, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast((h & {(1 << log_bits) - 1}) & 63 as int))").alias("bit"))
        .groupBy("at").agg(F.expr("bit_or(bit)").alias("word")).toArrow()
    )
    out = np.zeros(1 << max(0, log_bits - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out.view(np.uint8)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, log_bits: int = 23) -> DataFrame:
    """Which words of every document lie in a window of a benchmark item.

    Words are runs of letters, digits and non-ASCII characters after A-Z were
    lower-cased. An item's windows are its runs of ``window`` words; an item of
    fewer words is one window. Returns doc (the input row), doc_id, n_words,
    n_hit, n_items, items_sha256 (of the ids as sorted strings, joined by
    commas) and contaminated. Null and empty texts have no words; a null
    item_id marks words but is no item; equal rows are rows of their own.
    """
    spark = docs.sparkSession
    ts.small_batches(spark)
    items = stored(
        benchmark.select("item_id", "text").mapInArrow(_items(window, k), f"item_id {dict(benchmark.dtypes)['item_id']}, marks {MARK}")
        .select("item_id", F.explode("marks").alias("m")).select("item_id", "m.*"), "item-marks")
    bits = bit_map(items.select("h"), log_bits)
    short = [r[0] for r in items.filter(F.col("size") < window).select("size").distinct().orderBy("size").collect()]  # fewer than ``window`` sizes exist
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    kind = packed.schema["doc"].dataType.simpleString()
    found = packed.mapInArrow(_docs(window, k, bits, (1 << log_bits) - 1, short, docs.columns), f"doc {kind}, n_words long, marks {MARK}")
    found = stored(ts.with_row_id(found), "doc-marks")

    marks = found.select("_row", F.explode("marks").alias("m")).select("_row", "m.*").withColumn("w", F.split("words", " "))
    bench = items.select("item_id", "h", "size", F.col("lead").alias("ilead"), F.split("words", " ").alias("iw"))
    # a window that holds the k-gram begins at most window - k words before it, on both sides alike
    starts = F.expr(
        f"filter(sequence(0, if(size = {window}, {window - k}, 0)), o -> o <= lead and o <= ilead and size(slice(w, lead - o + 1, size)) = size"
        " and slice(w, lead - o + 1, size) = slice(iw, ilead - o + 1, size))")
    hits = (
        marks.join(bench, ["h", "size"]).select("_row", "item_id", "size", F.explode(starts).alias("o"), "pos")
        .select("_row", "item_id", "size", (F.col("pos") - F.col("o")).alias("start")).distinct()
    )
    per_doc = hits.groupBy("_row").agg(
        F.collect_set(F.struct("start", "size")).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    per_doc = per_doc.select(
        "_row", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("sha"),
        F.expr("cast(size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.size - 1))))) as bigint)").alias("n_hit"))
    return (
        found.select("_row", "doc", "n_words").join(per_doc, "_row", "left")
        .select("doc", F.col("doc.doc_id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
                (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"))
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The input rows that hold no window of any item."""
    return contamination(docs, benchmark, **how).filter("not contaminated").select("doc.*")
