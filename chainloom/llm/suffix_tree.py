"""Language-model scores by a probabilistic suffix tree over words.

A context is a run of up to ``depth`` words. The tree keeps every next word that
follows a context at least twice in the training texts, whatever their size, and
a context is a state if its next-word distribution diverges enough from that of
its longest shorter state. A state's entries are discounted; the mass left goes
to its shorter state, down to the root, which is the smoothed word count over
the whole corpus. A text is scored by the longest state that ends before each
token.

The tree is a written table, one level after the other: a run of words and what
it adds to the score of a text each time it ends there. That is, as the next
word of the context before it, how much its log probability differs from that
after the shorter context; and as a context of the next word, the log of the
mass it passes on. A level is counted, settled and looked up by shuffles of
buckets, which are ranges of hashes: a row holds the arrays of one bucket from
one task, so that memory follows a bucket (their number grows with the text) and
Spark moves few rows. Two things of bounded size spare most of what is looked up
and change no score: a bit map of the runs in the table, and the most frequent
runs, at most 1/``head_share`` a level, which travel to the tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from . import textscan as ts
from .labelled import remainder

#: The end of a text as a token: a hash no span gets but by chance.
END = np.uint64(0x454E44 * ts.BASE & 0xFFFFFFFFFFFFFFFF)
SHIFT = 24
#: Tokens whose runs are counted together before they travel, and items of one batch that does.
CHUNK = 1_000_000
STEP = 250_000
#: Bytes of text for each range of hashes that is worked on at once.
BUCKET = 8 << 20
DISCOUNT = 0.75
#: Bits of the maps of kept runs: 16 MB a level whatever the corpus; a full map lets more runs travel and changes no score.
LOG_BITS = 27


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, first token of each row); a row ends with END."""
    raw, offsets = ts.utf8(column)
    data = ts.LOWER[raw]
    starts, ends, first = ts.word_spans(data, offsets, ts.NONSPACE)
    h = np.insert(ts.hash_spans(data, starts, ends), first[1:], END)
    return h, first[:-1] + np.arange(len(first) - 1)


class Tree:
    """A tree held in memory, a level at a time: the rule by which the written tables settle states, in numpy."""

    def __init__(self, head: np.ndarray, count: np.ndarray, total: int, distinct: int):
        self.head, self.count = head, count
        self.total, self.distinct = total, distinct
        self.norm = total + 0.5 * (distinct + 1)
        self.root = np.log10((count + 0.5) / self.norm)
        #: Per level: sorted keys (shorter run's number, word) of the candidates.
        self.runs: list[np.ndarray] = []
        #: Per level and candidate: log10 of the mass passed on per unit, NaN if it is no state.
        self.passed: list[np.ndarray] = []
        #: Per level: sorted keys (candidate, next word) and their log10 probabilities.
        self.keys: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []

    def candidates(self, word: np.ndarray) -> list[np.ndarray]:
        """Per level the number of the candidate run that ends at each token, -1 if none."""
        out, last = [], np.zeros(len(word), np.int64)
        for level, runs in enumerate(self.runs):
            found = np.full(len(word), -1, np.int64)
            ok = np.flatnonzero((last >= 0) & (word >= 0))
            found[ok] = _find(runs, last[ok] << SHIFT | word[ok])
            out.append(found)
            last = np.append(-1, found[:-1])
        return out

    def log_next(self, word: np.ndarray) -> np.ndarray:
        """log10 of every token after the longest state before it; a rare token's own root term is left out."""
        out = np.where(word >= 0, self.root[word], 0.0) if len(self.root) else np.zeros(len(word))
        for level, runs in enumerate(self.candidates(word)):
            if level == len(self.keys):
                break
            before = np.append(-1, runs[:-1])
            at = np.flatnonzero(before >= 0)
            at = at[~np.isnan(self.passed[level][before[at]])]
            keys = before[at] << SHIFT | np.maximum(word[at], 0)
            entry = np.where(word[at] >= 0, _find(self.keys[level], keys), -1)
            value = self.passed[level][before[at]] + out[at]
            value[entry >= 0] = self.logs[level][entry[entry >= 0]]
            out[at] = value
        return out


def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def _parent_log(tree: Tree, level: int, run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log10 of a word after the longest state shorter than a candidate of ``level``."""
    spelled = []
    for d in range(level, -1, -1):
        spelled.append(tree.runs[d][run] & ((1 << SHIFT) - 1))
        run = tree.runs[d][run] >> SHIFT
    spelled = spelled[::-1]  # the run's words, first to last
    out = tree.root[word].copy()
    for d in range(level):  # states of d + 1 words that end the run
        state = np.zeros(len(word), np.int64)
        for e, w in enumerate(spelled[level - d:]):
            state = np.where(state >= 0, _find(tree.runs[e], np.maximum(state, 0) << SHIFT | w), -1)
        ok = np.flatnonzero(state >= 0)
        ok = ok[~np.isnan(tree.passed[d][state[ok]])]
        entry = _find(tree.keys[d], state[ok] << SHIFT | word[ok])
        value = tree.passed[d][state[ok]] + out[ok]
        value[entry >= 0] = tree.logs[d][entry[entry >= 0]]
        out[ok] = value
    return out


def _settle(tree: Tree, level: int, uses: np.ndarray, keys: np.ndarray, n: np.ndarray, divergence: float) -> None:
    """Turn counts of next words into states: entries, passed mass and the divergence test."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order].astype(float)
    run, word = keys >> SHIFT, keys & ((1 << SHIFT) - 1)
    p = (n - DISCOUNT) / uses[run]
    q = 10.0 ** _parent_log(tree, level, run, word)
    size = len(uses)
    kept, shorter = np.bincount(run, p, size), np.bincount(run, q, size)
    rest, rest_shorter = np.maximum(1 - kept, 1e-12), np.maximum(1 - shorter, 1e-12)
    far = np.bincount(run, p * np.log(p / q), size) + rest * np.log(rest / rest_shorter)
    state = far >= divergence
    passed = np.where(state, np.log10(rest / rest_shorter), np.nan)
    ok = state[run]
    tree.passed.append(passed)
    tree.keys.append(keys[ok])
    tree.logs.append(np.log10(p[ok]))


def runs_of(h: np.ndarray, first: np.ndarray, depth: int):
    """Level by level (hash of the run of level + 1 tokens that ends at each token, whether the run lies in one row)."""
    place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    out = [(h, np.ones(len(h), bool))]
    for level in range(1, depth + 1):
        last = out[-1][0]
        longer = np.zeros(len(h), np.uint64)
        longer[1:] = _run_hash(last[:-1], last[1:])
        out.append((longer, place >= level))
    return out


def _run_hash(context: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """A run's hash from those of its context (all but the last token) and its shorter run (all but the first)."""
    return ts.mix(context * np.uint64(ts.BASE) + shorter)


def _in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(65 - (8 * len(bits)).bit_length())
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


#: Rows that travel: the arrays of a row belong together, and a bucket is a range of hashes.
DEALT = "bucket int, part string, key array<long>, other array<long>, n array<long>, x array<double>, y array<double>"
TYPES = {"key": pa.int64(), "other": pa.int64(), "n": pa.int64(), "x": pa.float64(), "y": pa.float64()}


def _dealt(part: str, buckets: int, by: np.ndarray, **columns: np.ndarray):
    """Batches with a row per bucket of the hashes ``by``."""
    bucket = ((by >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    i = 0
    while i < len(names):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP, "right")))
        at, offsets = order[starts[i]: ends[j - 1]], pa.array(np.append(starts[i:j], ends[j - 1]) - starts[i], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(columns[c][at].view(np.int64) if t == pa.int64() else columns[c][at], t)) if c in columns else pa.nulls(j - i, pa.list_(t))
                 for c, t in TYPES.items()]
        yield pa.RecordBatch.from_arrays([pa.array(names[i:j], pa.int32()), pa.array([part] * (j - i)), *lists], ["bucket", "part", *TYPES])
        i = j


def _table(batches) -> pa.Table:
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.string()), *((c, pa.list_(t)) for c, t in TYPES.items())])
    return pa.Table.from_batches(list(batches), schema)


def _arrays(table: pa.Table, part: str, *columns: str) -> list[np.ndarray]:
    """The named columns of all rows of a part, end to end; ``key`` and ``other`` are hashes."""
    rows = table.filter(pc.equal(table.column("part"), part))
    out = [pc.list_flatten(rows.column(c)).to_numpy() for c in columns]
    return [x.view(np.uint64) if c in ("key", "other") else x for c, x in zip(columns, out)]


def _in_buckets(rows: DataFrame, work) -> DataFrame:
    """``work`` on the rows of each bucket, as one Arrow table."""
    return rows.groupBy("bucket").applyInArrow(work, DEALT)


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, a place of each, their sums)."""
    if not len(h):
        return h, np.zeros(0, np.int64), n
    order = np.argsort(h)
    starts = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]]))
    return h[order[starts]], order[starts], np.add.reduceat(n[order], starts)


def _chunks(batches, arrays):
    """Tuples of arrays of about CHUNK items from those that ``arrays`` takes from texts."""
    held, size = [], 0
    for whole in batches:
        for b in ts.slices(whole):
            found = arrays(b)
            if len(found[0]):
                held.append(found)
                size += len(found[0])
            if size >= CHUNK:
                yield [np.concatenate(x) for x in zip(*held)]
                held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _marked(least: float, log_bits: int):
    """The bytes of a bucket's part of a bit map, a bit per hash with enough occurrences, and the place of the first."""
    def work(table):
        h, n = (np.concatenate(x) for x in zip(*(_arrays(table, part, "key", "n") for part in ("last", "value"))))
        slot = np.sort(h[n >= least] >> np.uint64(64 - log_bits))
        if not len(slot):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], ["at", "bits"])
        at, starts = np.unique((slot >> np.uint64(3)).astype(np.int64), return_index=True)
        out = np.zeros(at[-1] - at[0] + 1, np.uint8)
        out[at - at[0]] = np.bitwise_or.reduceat(np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8), starts)
        return pa.table([pa.array([at[0]], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["at", "bits"])
    return work


def _bit_map(rows: DataFrame, least: float, log_bits: int) -> np.ndarray:
    """One bit per range of hashes, ``2 ** log_bits`` bits however many hashes there are; as many come to the driver."""
    found = _only(rows, "key", "n").groupBy("bucket").applyInArrow(_marked(least, log_bits), "at long, bits binary").toArrow()
    out = np.zeros(1 << (log_bits - 3), np.uint8)
    for at, bits in zip(found.column("at").to_pylist(), found.column("bits")):
        part = np.frombuffer(bits.as_buffer(), np.uint8)
        out[at: at + len(part)] |= part
    return out


def _words(buckets: int):
    def run(batches):
        for (h,) in _chunks(batches, lambda b: tokens(b.column("text"))[:1]):
            h, n = np.unique(h, return_counts=True)
            yield from _dealt("run", buckets, h, key=h, n=n)
    return run


def _counted_words(buckets: int):
    def work(table):
        h, _, n = _summed(*_arrays(table, "run", "key", "n"))
        return _table(_dealt("last", buckets, h, key=h, n=n))
    return work


def _rooted(norm: float):
    """Words as the level of no context: x is their log probability, y what they add to a score."""
    def run(batches):
        for b in batches:
            n = b.column("n")
            log = pa.ListArray.from_arrays(n.offsets, pa.array(np.log10((n.values.to_numpy() + 0.5) / norm)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("bucket", "part", "key", "other", "n")), log, log], b.schema.names)
    return run


def _longer(level: int, bits: np.ndarray, buckets: int):
    """Counts of the runs of level + 1 tokens whose context and whose shorter run can both be kept, a chunk at a time."""
    def found(b):
        h, first = tokens(b.column("text"))
        shorter, (_, inside) = runs_of(h, first, level)[-2:]
        kept = _in_map(bits, shorter[0])
        at = np.flatnonzero(inside & kept & np.append(False, kept[:-1]))
        return shorter[0][at - 1], shorter[0][at]

    def run(batches):
        for context, shorter in _chunks(batches, found):
            h, at, n = _summed(_run_hash(context, shorter), np.ones(len(context), np.int64))
            yield from _dealt("run", buckets, h, key=context[at], other=shorter[at], n=n)
    return run


def _kept(least: float, buckets: int):
    """Runs that occur often enough, dealt by their shorter run: key is the shorter run, other the context."""
    def work(table):
        context, shorter, n = _arrays(table, "run", "key", "other", "n")
        _, at, n = _summed(_run_hash(context, shorter), n)
        at, n = at[n >= least], n[n >= least]
        return _table(_dealt("run", buckets, shorter[at], key=shorter[at], other=context[at], n=n))
    return work


def _joined(buckets: int):
    """Each run with the log probability its last word has after the shorter context (x), dealt by context."""
    def work(table):
        shorter, context, n = _arrays(table, "run", "key", "other", "n")
        key, log = _by_key(table, "last", "key", "x")
        at = _find(key, shorter)
        has = at >= 0
        return _table(_dealt("run", buckets, context[has], key=context[has], other=shorter[has], n=n[has], x=log[at[has]]))
    return work


def _by_key(table: pa.Table, part: str, *columns: str) -> list[np.ndarray]:
    out = _arrays(table, part, *columns)
    order = np.argsort(out[0])
    return [x[order] for x in out]


def _settled(often: float, divergence: float, level: int, buckets: int):
    """Settles the contexts of a bucket: the runs of this level (last), and what each of the level before adds to a score (value)."""
    def work(table):
        context, shorter, n, before = _arrays(table, "run", "key", "other", "n", "x")
        key, uses, add = _by_key(table, "last", "key", "n", "y")
        at = _find(key, context)
        ok = at >= 0
        ok[ok] = uses[at[ok]] >= often
        at, n, before, h = at[ok], n[ok], before[ok], _run_hash(context[ok], shorter[ok])
        p, q, size = (n - DISCOUNT) / uses[at], 10.0 ** before, len(key)
        rest, rest_shorter = (np.maximum(1 - np.bincount(at, x, size), 1e-12) for x in (p, q))
        far = np.bincount(at, p * np.log(p / q), size) + rest * np.log(rest / rest_shorter)
        state = (far >= divergence) & (np.bincount(at, minlength=size) > 0)
        passed = np.where(state, np.log10(rest / rest_shorter), 0.0)
        after = np.where(state[at], np.log10(p), before)
        value = add + passed
        told = np.flatnonzero(value != 0) if level > 1 else np.arange(size)  # words are all kept, as they are known
        return _table([*_dealt("last", buckets, h, key=h, n=n, x=after, y=np.where(state[at], after - before - passed[at], 0.0)),
                       *_dealt("value", buckets, key[told], key=key[told], n=uses[told], x=value[told])])
    return work


def _last_values(batches):
    """The longest runs are no contexts: what they add is their value."""
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t.set_column(1, "part", pa.array(["value"] * len(t), pa.string())).set_column(5, "x", t.column("y"))
        yield from t.to_batches()


def _frequent(least: float):
    """Keys, values and counts of the runs with enough occurrences."""
    def run(batches):
        for b in batches:
            key, n, x = (b.column(c).flatten().to_numpy() for c in ("key", "n", "x"))
            at = np.flatnonzero(n >= least)
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(x[at]), pa.array(n[at])], ["h", "value", "n"])
    return run


class Lookup:
    """What travels to the tasks of a level: its frequent words or runs, and a map of all runs in its table."""

    def __init__(self, level: int, key: np.ndarray, value: np.ndarray, root: np.ndarray, bits: np.ndarray | None):
        self.level, self.key, self.value, self.root, self.bits = level, key, value, root, bits


def _asked(look: Lookup, buckets: int):
    """Per text what the frequent runs add (sum: key is the row, other its tokens), and the other runs to be found in the table (ask: other is the row, n how often)."""
    def run(batches):
        for whole in batches:
            for b in ts.slices(whole):
                h, first = tokens(b.column("text"))
                row = b.column("row").to_numpy().view(np.uint64)
                size = len(first)
                n = np.diff(np.append(first, len(h)))
                own = np.repeat(np.arange(size), n)
                run_, inside = runs_of(h, first, look.level)[-1]
                at = np.arange(len(h)) if look.bits is None else np.flatnonzero(inside & _in_map(look.bits, run_))
                values, back = np.unique(run_[at], return_inverse=True)
                found = _find(look.key, values)[back]
                has = found >= 0
                mine, found = own[at[has]], found[has]
                known, base = np.zeros(size, np.int64), np.zeros(size)
                if not look.level:
                    known, base = np.bincount(mine, minlength=size), np.bincount(mine, look.root[found], size)
                yield from _dealt("sum", buckets, row, key=row, other=n if not look.level else np.zeros(size, np.int64), n=known,
                                  x=np.bincount(mine, look.value[found], size), y=base)
                pairs, n = np.unique(back[~has] * size + own[at[~has]], return_counts=True)
                if len(pairs):
                    asked = values[pairs // size]
                    yield from _dealt("ask", buckets, asked, key=asked, other=row[pairs % size], n=n)
    return run


def _answered(level: int, norm: float, buckets: int):
    """What the asked words or runs add to each row, dealt by row, beside the sums that came with them."""
    def work(table):
        sums = table.filter(pc.equal(table.column("part"), "sum"))
        asked, row, times = _arrays(table, "ask", "key", "other", "n")
        if not len(asked):
            return sums.select(["bucket", "part", *TYPES])
        key, value, n = _by_key(table, "value", "key", "x", "n")
        at = _find(key, asked)
        row, back = np.unique(row, return_inverse=True)
        has = at >= 0
        at, size, mine, often = at[has], len(row), back[has], times[has]
        x = np.bincount(mine, often * value[at], size)
        known, base = np.zeros(size, np.int64), np.zeros(size)
        if not level:
            unknown = math.log10(0.5 / norm) * np.bincount(back[~has], times[~has], size)
            known, x, base = np.bincount(mine, often, size).astype(np.int64), x + unknown, np.bincount(mine, often * np.log10((n[at] + 0.5) / norm), size) + unknown
        return pa.concat_tables([sums.select(["bucket", "part", *TYPES]),
                                 _table(_dealt("sum", buckets, row, key=row, other=np.zeros(size, np.int64), n=known, x=x, y=base))])
    return work


def _added(buckets: int):
    """One item per row of the input."""
    def work(table):
        row, n_tokens, known, score, base = _arrays(table, "sum", "key", "other", "n", "x", "y")
        row, back = np.unique(row, return_inverse=True)
        size = len(row)
        n_tokens, known = (np.bincount(back, x.view(np.int64), size).astype(np.int64) for x in (n_tokens, known))
        return _table(_dealt("sum", buckets, row, key=row, other=n_tokens, n=known, x=np.bincount(back, score, size), y=np.bincount(back, base, size)))
    return work


def learn(texts: DataFrame, depth: int, context_share: float, entry_share: float, divergence: float, buckets: int, log_bits: int = LOG_BITS):
    """A level after the other (its table of values, tokens, norm), words first: ``texts`` has a column text; every text counts whole.

    A value is what a word or run adds to the score of a text that holds it. A
    run that adds nothing is in no table. A table goes when the next is asked for.
    """
    texts = texts.select("text")
    held = stored(_in_buckets(texts.mapInArrow(_words(buckets), DEALT), _counted_words(buckets)), "words")
    total, distinct = held.agg(F.coalesce(F.sum(F.expr("aggregate(n, 0L, (s, v) -> s + v)")), F.lit(0)), F.coalesce(F.sum(F.size("key")), F.lit(0))).first()
    norm = total + 0.5 * (distinct + 1)
    last = held.mapInArrow(_rooted(norm), DEALT)
    often, least = max(2.0, total * context_share), max(2.0, total * entry_share)
    for level in range(1, depth + 1):
        bits = _bit_map(last, min(often, least), log_bits)
        if not bits.any():
            break
        counted = stored(_in_buckets(texts.mapInArrow(_longer(level, bits, buckets), DEALT), _kept(least, buckets)), "counted")
        joined = _in_buckets(counted.union(_only(last, "key", "x")), _joined(buckets))
        new = stored(_in_buckets(joined.union(_only(last, "key", "n", "y")), _settled(often, divergence, level, buckets)), "level")
        discard(counted, held)
        held, last = new, new.filter("part = 'last'")
        yield new.filter("part = 'value'"), total, norm
    yield last.mapInArrow(_last_values, DEALT), total, norm
    discard(held)


def _only(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows with no arrays but these."""
    return rows.select(*[c if c in ("bucket", "part", *columns) else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])


def suffix_scores(docs: DataFrame, depth: int = 3, context_share: float = 0.0, entry_share: float = 0.0, head_share: float = 5e-7, divergence: float = 0.02) -> DataFrame:
    """Scores of every document by a tree learnt from those whose crc32(doc_id as text) mod 5 is not 1.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score, one row per input row. A null or empty text is its end alone; a null
    doc_id is not held out; equal rows count and are scored each. Without
    training text every token has the chance of an unknown one. A caller can ask
    for contexts or next words that make a share of all tokens; by default two
    occurrences are enough at any size.
    """
    ts.small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    buckets = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET + 1
    rows = docs.withColumn("row", F.xxhash64("doc_id", "text"))  # equal rows share it, and their scores
    sums = None
    texts = docs.filter(remainder(F.col("doc_id"), 5) != 1)
    for level, (table, total, norm) in enumerate(learn(texts, depth, context_share, entry_share, divergence, buckets)):
        head = table.mapInArrow(_frequent(total * head_share * (4 if level else 1)), "h long, value double, n long").toArrow()  # at most 1 / head_share rows, a quarter of that for runs
        h, value, n = (head.column(c).to_numpy() for c in ("h", "value", "n"))
        order = np.argsort(h.view(np.uint64))
        bits = _bit_map(table, 0, LOG_BITS) if level else None
        look = Lookup(level, h.view(np.uint64)[order], value[order], np.log10((n[order] + 0.5) / norm) if not level else value[:0], bits)
        asked = rows.select("row", "text").mapInArrow(_asked(look, buckets), DEALT)
        found = stored(_in_buckets(_in_buckets(asked.union(table), _answered(level, norm, buckets)), _added(buckets)), "sums")
        sums = found if sums is None else sums.union(found)
    added = (
        sums.select(F.explode(F.arrays_zip("key", "other", "n", "x", "y")).alias("s")).groupBy(F.col("s.key").alias("row"))
        .agg(F.sum("s.other").alias("n_tokens"), F.sum("s.n").alias("n_known"), F.sum("s.y").alias("base_score"), F.sum("s.x").alias("score"))
    )
    copies = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    each = [(F.col(c) / F.col("copies")).cast("long" if c.startswith("n_") else "double").alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    return (
        copies.join(added, "row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select("doc_id", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), *each[:2], F.lit(total).cast("long").alias("train_tokens"), *each[2:])
    )
