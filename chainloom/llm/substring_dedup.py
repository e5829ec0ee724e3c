"""Substring deduplication by sliding sentence spans.

A sentence of more than LONGEST words counts as pieces: a piece begins at every
word with the smallest hash of some SPAN consecutive words of the sentence. The
cuts depend on the words around them only, so they move with a passage, whatever
stands before it, and texts without full stops are covered too. A piece has at
most SPAN words, and two copies of 50 words share a run wherever they stand. From every sentence a run begins: the fewest
consecutive sentences, two at least, that hold ``min_words`` words. Runs are hashed and joined over the whole
corpus; sentences covered by a run that occurred before (in an earlier row, or
earlier in the same text) are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import textscan as ts
from .decontaminate import winnow

RUN = "array<struct<h:bigint,pos:int,size:int>>"
RUN_TYPE = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("size", pa.int32())]))
COVER_TYPE = pa.list_(pa.struct([("pos", pa.int32()), ("size", pa.int32())]))

LONGEST = 12
SPAN = 10

_END = np.zeros(256, bool)
_END[[0x2E, 0x21, 0x3F]] = True  # . ! ?
_SPACE = ~ts.NONSPACE


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): sentences end after . ! ? before white space and at line feeds, long ones at words chosen by their hash too; spans are trimmed and hold a character."""
    starts, ends, first = ts.word_spans(data, offsets, ts.NONSPACE)
    if not len(starts):
        return starts, ends, first
    # a word opens a sentence if it is the first of its row or the one before closed its own
    opens = np.zeros(len(starts), bool)
    opens[1:] = _END[data[ends[:-1] - 1]]
    feeds = np.flatnonzero(data == 0x0A)
    opens[1:] |= np.searchsorted(feeds, starts[1:]) > np.searchsorted(feeds, ends[:-1])
    opens[first[:-1][first[:-1] < len(starts)]] = True
    head = np.flatnonzero(opens)
    size = np.diff(np.append(head, len(starts)))
    at = np.flatnonzero(np.repeat(size > LONGEST, size))
    if len(at):
        h = ts.hash_spans(ts.LOWER[data], starts[at], ends[at])
        opens[at[winnow(h, np.arange(len(at)), np.repeat(head, size)[at], SPAN)]] = True
        head = np.flatnonzero(opens)
    begin = starts[head]
    return begin, ends[np.append(head[1:], len(starts)) - 1], np.searchsorted(begin, offsets)


def runs_of(column, min_words: int):
    """Per row (number of sentences, [(hash, first sentence, sentences)])."""
    raw, offsets = ts.utf8(column)
    data = ts.LOWER[raw]
    starts, ends, first = sentences(data, offsets)
    h = ts.hash_spans(data, starts, ends)
    ws, _, _ = ts.word_spans(data, offsets, ts.NONSPACE)
    words = np.concatenate(([0], np.cumsum(np.searchsorted(ws, ends) - np.searchsorted(ws, starts))))
    row_end = np.repeat(first[1:], np.diff(first))
    # the fewest sentences from i on that hold enough words
    stop = np.maximum(np.searchsorted(words, words[:-1] + min_words), np.arange(len(h)) + 2)
    at = np.flatnonzero(stop <= row_end)
    size = stop[at] - at
    out = np.zeros(len(at), np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        more = size > k
        out[more] = ts.mix(out[more] * np.uint64(ts.BASE) + h[at[more] + k])
    return first, at, size, ts.mix(out + size.astype(np.uint64))


def _spans(min_words: int):
    def run(batches):
        for whole in batches:
            for b in ts.slices_of(whole, lambda t: t.column("doc").field("text")):
                first, at, size, h = runs_of(b.column("doc").field("text"), min_words)
                edges = np.searchsorted(at, first)
                runs, own = [], []
                for a, e, f in zip(edges[:-1], edges[1:], first[:-1]):
                    _, head = np.unique(h[a:e], return_index=True)
                    new = np.zeros(e - a, bool)
                    new[head] = True
                    runs.append([{"h": x, "pos": p, "size": s} for x, p, s in zip(h[a:e][new].view(np.int64).tolist(), (at[a:e][new] - f).tolist(), size[a:e][new].tolist())])
                    own.append([{"pos": p, "size": s} for p, s in zip((at[a:e][~new] - f).tolist(), size[a:e][~new].tolist())])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc"), pa.array(np.diff(first).astype(np.int64)), pa.array(runs, RUN_TYPE), pa.array(own, COVER_TYPE)], ["doc", "n_sentences", "runs", "own"])
    return run


def cleaned(text: str, covers: list[dict]) -> tuple[str, int]:
    """The text without the covered sentences and the space that followed each."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = sentences(raw, np.array([0, len(raw)]))
    gone = np.zeros(len(starts), bool)
    for c in covers:
        gone[c["pos"]: c["pos"] + c["size"]] = True
    if not gone.any():
        return text, 0
    data, pieces, at = raw.tobytes(), [], 0
    upto = np.append(starts[1:], len(raw))
    for i in np.flatnonzero(gone):
        pieces.append(data[at: starts[i]])
        at = int(upto[i])
    pieces.append(data[at:])
    return b"".join(pieces).decode(), int(gone.sum())


def _remove(batches):
    for b in batches:
        out, gone = [], []
        for text, own, more in zip(b.column("text").to_pylist(), b.column("own").to_pylist(), b.column("covers").to_pylist()):
            t, n = (text, 0) if not own and not more else cleaned(text or "", (own or []) + (more or []))
            out.append(t)
            gone.append(n)
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(out, pa.string()), b.column("n_sentences"), pa.array(gone, pa.int64())], ["doc", "text", "n_sentences", "n_removed"])


def repeated_spans(docs: DataFrame, min_words: int = 12) -> DataFrame:
    """Every row with the sentences removed that a non-first run covers.

    Returns doc (the input row), doc_id, text (what remains), n_sentences and
    n_removed. First is the earlier row of the table, and within a text the
    earlier place. Null texts stay null and have no sentences; of equal rows the
    later lose what they share.
    """
    ts.small_batches(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    kind = packed.schema["doc"].dataType.simpleString()
    cover = "array<struct<pos:int,size:int>>"
    base = stored(ts.with_row_id(packed.mapInArrow(_spans(min_words), f"doc {kind}, n_sentences long, runs {RUN}, own {cover}")), "spans")
    runs = base.select("_row", F.explode("runs").alias("r")).select("_row", "r.*")
    repeated = stored(runs.groupBy("h").agg(F.min("_row").alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first"), "repeated")
    covers = (
        runs.join(repeated, "h").filter("_row <> first").groupBy("_row")
        .agg(F.collect_list(F.struct("pos", "size")).alias("covers"))  # at most one per sentence of the row
    )
    out = base.select("_row", "doc", "n_sentences", "own").join(covers, "_row", "left").select("doc", F.col("doc.text").alias("text"), "n_sentences", "own", "covers")
    return out.mapInArrow(_remove, f"doc {kind}, text string, n_sentences long, n_removed long").select(
        "doc", F.col("doc.doc_id").alias("doc_id"), "text", "n_sentences", "n_removed")
