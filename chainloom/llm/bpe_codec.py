"""Byte-pair encoding by tree concatenation, and decoding.

Texts are cut where no merge can reach across: at ASCII white space, and between
an ASCII letter and a mark. A stretch that has no such place and is longer than
a leaf is normalized, split as the tokenizer splits it, and what is still unsplit
is cut anywhere into leaves. Leaves are encoded in parallel. Two neighbours are
joined by encoding a window around the join anew; it grows on the side where its
outermost token is not the one that side had, until both sides agree. An encoding
is right if every two neighbouring tokens are what their own text encodes to, so
a window that begins and ends with its sides' own tokens makes the whole exact.
Joins form a tree: halves first, then the halves of halves.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import textscan as ts

#: Bytes of text, or symbols of an unsplit stretch, that one task encodes at a time.
LEAF = 1 << 15
#: Distinct stretches whose ids a worker remembers.
KEPT_UNITS = 300_000

#: Beside an ASCII letter these end a stretch: the tokenizer never joins them to it, and no special token or contraction holds them.
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!\"#$%&()*+,-./:;?@[]^_`{}~"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Codec:
    """A tokenizer file's merges with and without a word's end, and joins of their results."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end = self.spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.mark = _MARK.copy()
        self.mark[[ord(c) for s in self.special for c in s if ord(c) < 128]] = False
        self.token = [""] * (1 + max([*self.spec["model"]["vocab"].values(), *self.special.values()]))
        for t, i in [*self.spec["model"]["vocab"].items(), *self.special.items()]:
            self.token[i] = t
        self._inner = None
        self.forget()

    # encoding of leaves

    def forget(self) -> None:
        self.known, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 20, np.int32), 0

    def _learn(self, hashes: np.ndarray, units: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        size = np.array([len(g) for g in got], np.int64)
        ids = np.array([i for g in got for i in g], np.int32)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used: self.used + len(ids)] = ids
        begin = self.used + np.cumsum(size) - size
        self.used += len(ids)
        at = np.searchsorted(self.known, hashes)
        self.known, self.begin, self.size = (np.insert(x, at, y) for x, y in ((self.known, hashes), (self.begin, begin), (self.size, size)))

    def encode_texts(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row); each distinct stretch is given to the tokenizer once."""
        data, offsets = ts.utf8(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        starts, ends, _ = ts.word_spans(data, offsets, ts.NONSPACE)
        cut = np.zeros(len(data), bool)
        cut[1:] = (_LETTER[data[1:]] & self.mark[data[:-1]]) | (self.mark[data[1:]] & _LETTER[data[:-1]])
        cut[starts] = False
        cut[offsets[offsets < len(data)]] = False
        inside = np.flatnonzero(cut)
        starts, ends = np.sort(np.concatenate((starts, inside))), np.sort(np.concatenate((ends, inside)))
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        unique, index, back = np.unique(ts.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > KEPT_UNITS:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, unique), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[at] != unique) if len(self.known) else np.arange(len(unique))
        if len(new):
            raw = data.tobytes()
            self._learn(unique[new], [raw[s:e].decode() for s, e in zip(starts[index[new]].tolist(), ends[index[new]].tolist())])
            at = np.searchsorted(self.known, unique)
        begin, n = self.begin[at][back], self.size[at][back]
        out = np.concatenate(([0], np.cumsum(n)))
        ids = self.pool[np.arange(out[-1]) + np.repeat(begin - out[:-1], n)]
        first = np.searchsorted(starts, offsets)
        return ids, out[first[1:]] - out[first[:-1]]

    def encode_part(self, symbols: str, last: bool) -> list[int]:
        """Ids of a part of an unsplit stretch in the tokenizer's byte symbols; only the last part has the word's end."""
        if last:
            return [t.id for t in self.tokenizer.model.tokenize(symbols)]
        if self._inner is None:
            from tokenizers import models
            m = self.spec["model"]
            self._inner = models.BPE(m["vocab"], [tuple(p) if isinstance(p, list) else tuple(p.split(" ")) for p in m["merges"]])
        return [t.id for t in self._inner.tokenize(symbols)]

    def leaf(self, kind: str, text: str) -> list[int]:
        if kind == "text":
            return self.encode_texts(pa.array([text]))[0].tolist()
        if kind == "words":
            return [i for w in text.split(" ") for i in self.encode_part(w, True)]
        if kind == "special":
            return [self.special[text]]
        return self.encode_part(text, kind == "last")

    # cutting

    def leaves(self, text: str, size: int = LEAF):
        """(kind, text) of a whole text's leaves: texts, words, special tokens, and parts of unsplit words, the last named so."""
        raw = text.encode()
        starts, ends, _ = ts.word_spans(data := np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ts.NONSPACE)
        begin, i = 0, 0
        while i < len(starts):
            if ends[i] - starts[i] > size:
                yield from self._unsplit(raw[starts[i]: ends[i]].decode(), size)
                i += 1
                continue
            begin = starts[i]
            j = i + 1
            while j < len(starts) and ends[j] - begin <= size:
                j += 1
            yield "text", raw[begin: ends[j - 1]].decode()
            i = j

    def _unsplit(self, stretch: str, size: int):
        names = "|".join(re.escape(s) for s in sorted(self.special))
        for piece in re.split(f"({names})", stretch) if names else [stretch]:
            if piece in self.special:
                yield "special", piece
                continue
            words, held = [], 0
            for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(piece)):
                if held + len(word) > size and words:
                    yield "words", " ".join(words)
                    words, held = [], 0
                if len(word) <= size:
                    words.append(word)
                    held += len(word)
                    continue
                for at in range(0, len(word), size):
                    yield "last" if at + size >= len(word) else "part", word[at: at + size]
            if words:
                yield "words", " ".join(words)

    # joining

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Ids of two neighbours' concatenation, each given as the ids of its own text; ``last``: the right one holds the word's end."""
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            ended = last and j == len(right)
            symbols = "".join([self.token[t] for t in left[-i:]] + [self.token[t] for t in right[:j]])
            window = self.encode_part(symbols.removesuffix(self.end) if ended else symbols, ended)
            left_agrees = i == len(left) or window[0] == left[-i]
            right_agrees = j == len(right) or window[-1] == right[j - 1]
            if left_agrees and right_agrees:
                return left[:-i] + window + right[j:]
            if not left_agrees:
                i *= 2
            if not right_agrees:
                j *= 2

    def concatenated(self, parts: list[list[int]], last: bool = True) -> list[int]:
        """Ids of one unsplit word from its parts' ids, by halves."""
        if len(parts) == 1:
            return parts[0]
        half = len(parts) // 2
        return self.join(self.concatenated(parts[:half], False), self.concatenated(parts[half:], last), last)


@lru_cache(2)
def codec_of(path: str) -> Codec:
    """One per worker process and file, so that what it remembers serves all its tasks."""
    return Codec(path)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _lists(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids, pa.int32()))


def _encode(path: str):
    def run(batches):
        codec = codec_of(path)
        for whole in batches:
            for b in ts.slices(whole, most=1 << 20):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(*codec.encode_texts(b.column("text")))], ["doc_id", "ids"])
    return run


def _cut(path: str, size: int):
    def run(batches):
        codec = codec_of(path)
        for b in batches:
            for row, doc, text in zip(*(b.column(c).to_pylist() for c in ("_row", "doc_id", "text"))):
                kinds, texts, held, at = [], [], 0, 0
                found = list(codec.leaves(text, size)) or [("text", "")]
                for kind, leaf in [*found, (None, "")]:
                    if kinds and (kind is None or held > 1 << 22):
                        n = len(kinds)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row] * n, pa.int64()), pa.array([doc] * n, b.column("doc_id").type), pa.array(range(at, at + n), pa.int64()), pa.array(kinds), pa.array(texts)],
                            ["_row", "doc_id", "at", "kind", "text"])
                        kinds, texts, held, at = [], [], 0, at + n
                    kinds.append(kind)
                    texts.append(leaf)
                    held += len(leaf)
    return run


def _encode_leaves(path: str):
    def run(batches):
        codec = codec_of(path)
        for b in batches:
            ids = [codec.leaf(k, t) for k, t in zip(b.column("kind").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("_row"), b.column("doc_id"), b.column("at"), b.column("kind"), pa.array(ids, pa.list_(pa.int32()))], ["_row", "doc_id", "at", "kind", "ids"])
    return run


def _join(path: str):
    def run(table: pa.Table) -> pa.Table:
        codec = codec_of(path)
        table = table.sort_by("at")
        ids, word = [], []
        for kind, got in zip(table.column("kind").to_pylist(), table.column("ids").to_pylist()):
            if kind in ("part", "last"):
                word.append(got)
                if kind == "last":
                    ids += codec.concatenated(word)
                    word = []
            else:
                ids += got
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int32()))})
    return run


def _decode(path: str):
    """Ids to text, as a tokenizer without a decoder does: its tokens, one space between them."""
    def run(batches):
        codec = codec_of(path)
        token = np.array(codec.token, object)
        for b in batches:
            values, first = _flat(b.column("ids"))
            got = token[values].tolist()
            text = [" ".join(got[a:e]) for a, e in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(text, pa.string())], ["doc_id", "ids", "text"])
    return run


def _flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))


def _digest(batches):
    decimal: dict[int, str] = {}
    for b in batches:
        values, first = _flat(b.column("ids"))
        distinct, place = np.unique(values, return_inverse=True)
        spelled = np.array([decimal.setdefault(i, str(i)) for i in distinct.tolist()], object)[place].tolist() if len(distinct) else []
        ids = [hashlib.sha256(" ".join(spelled[a:e]).encode()).hexdigest() for a, e in zip(first[:-1].tolist(), first[1:].tolist())]
        text = [hashlib.sha256(t.as_buffer()).hexdigest() for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(ids), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _then(*steps):
    """The steps one after the other in one worker, without a way back to the JVM between them."""
    def run(batches):
        for step in steps:
            batches = step(batches)
        return batches
    return run


def _through(docs: DataFrame, path: str, leaf: int, steps: list, schema: str) -> DataFrame:
    """All documents encoded and then led through ``steps``: short texts at once, long ones by leaves that any task may take."""
    spark = docs.sparkSession
    ts.small_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    given = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.octet_length("text") > leaf
    short = given.filter(~long).mapInArrow(_then(_encode(path), *steps), schema)
    leaves = stored(
        ts.with_row_id(given.filter(long)).select("_row", "doc_id", "text").mapInArrow(_cut(path, leaf), f"_row long, doc_id {kind}, at long, kind string, text string"), "leaves")
    encoded = leaves.repartition("_row", "at").mapInArrow(_encode_leaves(path), f"_row long, doc_id {kind}, at long, kind string, ids array<int>")
    # a group is one document, which was one row and becomes one row again
    joined = encoded.groupBy("_row").applyInArrow(_join(path), f"doc_id {kind}, ids array<int>")
    return short.unionByName(joined.mapInArrow(_then(*steps), schema) if steps else joined)


def encoded(docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text, as the tokenizers library encodes it without special tokens added.

    Special tokens that stand in a text are found, as the library does. Null and
    empty texts have no ids; equal rows are rows of their own, a null doc_id is
    kept, other columns are not read. The file must be a BPE with a word end
    and without a decoder, whose pre-tokenizer drops white space.
    """
    return _through(docs, tokenizer or default_tokenizer(), leaf, [], f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decoded(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids and their text, special tokens included; null or no ids give an empty text, an id that the file lacks an error."""
    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(_decode(tokenizer or default_tokenizer()), f"doc_id {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids in decimals and of the decoded text, for every row of ``encoded``."""
    path = tokenizer or default_tokenizer()
    return _through(docs, path, leaf, [_decode(path), _digest], f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
