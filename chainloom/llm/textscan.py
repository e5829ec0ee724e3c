"""Words of whole texts as numpy spans over Arrow's UTF-8 buffers.

All rules used here separate words by ASCII characters only, so a word never
begins or ends inside a multi-byte character and bytes can be scanned directly.
Hashes are 64 bits wide: polynomials over a span's bytes, then mixed. Work goes
through windows of a fixed number of bytes, so memory follows the batch and not
the longest text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1

_upper = np.arange(256, dtype=np.uint8)
_upper[65:91] += 32
LOWER = _upper

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` and of ``[^\x20\x09-\x0D]``.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[0x20] = False
NONSPACE[0x09:0x0E] = False


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows: a batch of very long texts must fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): runs of bytes in ``table``, never across rows; row i owns words first[i]:first[i + 1]."""
    inside = table[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[offsets < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    edges = offsets[offsets > 0] - 1
    after[edges] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for factor in (BASE, inverse):
        p = np.full(WINDOW + 1, factor, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every span; equal bytes give equal hashes wherever they stand."""
    power, inverse = _powers()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + WINDOW, "right"))
        if j <= i:  # one span longer than the window
            total = 0
            for k, at in enumerate(range(int(base), int(ends[i]), WINDOW)):
                piece = data[at: min(at + WINDOW, int(ends[i]))].astype(np.uint64) + np.uint64(1)
                part = int((piece * power[: len(piece)]).sum(dtype=np.uint64))
                total = (total + part * pow(BASE, k * WINDOW, 1 << 64)) & 0xFFFFFFFFFFFFFFFF
            out[i] = total
            i += 1
            continue
        piece = data[base: ends[j - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.empty(len(piece) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(piece * power[: len(piece)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes; positions whose k words cross a row are the caller's to skip."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + words[j: j + n]
    return mix(out)


def whole_grams(first: np.ndarray, k: int) -> np.ndarray:
    """Positions of words that begin k words of one row."""
    n = int(first[-1])
    ok = np.zeros(n, bool)
    length = np.maximum(first[1:] - first[:-1] - k + 1, 0)
    starts = np.repeat(first[:-1], length)
    before = np.concatenate(([0], np.cumsum(length)))[:-1]
    ok[starts + np.arange(len(starts)) - np.repeat(before, length)] = True
    return np.flatnonzero(ok)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def slices_of(batch: pa.RecordBatch, text, most: int = 4 << 20):
    """The batch in runs of rows with at most ``most`` bytes in the column that ``text`` picks, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(text(batch)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(size)
    yield batch.slice(begin)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20):
    return slices_of(batch, lambda b: b.column(column), most)


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A number per row; only stable once the frame is written, as its users do."""
    return df.withColumn(name, F.monotonically_increasing_id())
