"""Near-duplicate documents by HyperMinHash.

A document's distinct word shingles are dealt to registers by their hash; a
register keeps its smallest hash as a count of leading zeros plus mantissa bits
(two bytes). Bands of registers propose pairs, the collision-corrected estimate
over all registers thins them, and exact Jaccard on the full shingle sets
confirms each. At a similarity of 0.85 a pair misses all 24 bands of 4
registers with a chance below 1e-7; the estimate rejects only beyond five
standard errors.

A band shared by many documents does not become all pairs: its members are
compared with the member that shares most bands with others. In bands that then
still hold different components, members whose estimates allow a link join to
families, and a family is compared in blocks of bounded size, where a product
of incidence matrices counts the common shingles of all pairs exactly. Either
step returns a spanning forest of each block and not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import textscan as ts
from .components import components

BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
EMPTY = 0xFFFF
#: Chance that two different minima get the same register: about one in 2^MANTISSA, as most minima share few zero counts.
COLLISION = 2.0 ** -MANTISSA
BLOCK = 512
COLUMNS = 4096


def shingle_sets(data, offsets, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; fewer words are one shingle, no word is the empty set."""
    data = ts.LOWER[data]
    starts, ends, first = ts.word_spans(data, offsets, ts.NONSPACE)
    words = ts.hash_spans(data, starts, ends)
    grams = ts.gram_hashes(words, k)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(grams[a: b - k + 1]))
        elif b > a:
            out.append(ts.gram_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of REGISTERS registers for every set."""
    out = np.full((len(sets), REGISTERS), EMPTY, np.uint16)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    x = np.concatenate(sets)
    cell = np.repeat(np.arange(len(sets), dtype=np.int64), sizes) * REGISTERS + ((x >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    low = np.minimum.reduceat(ts.mix(x) >> np.uint64(12), head)  # 52 bits: exact in a double
    zeros = 52 - np.frexp(low.astype(np.float64))[1]
    mantissa = np.where(low > 0, (low << zeros.astype(np.uint64)) >> np.uint64(52 - 1 - MANTISSA), 0) & np.uint64((1 << MANTISSA) - 1)
    out.reshape(-1)[cell[head]] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, its slack): share of equal registers among used ones, without chance collisions."""
    used = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(used.sum(-1), 1)
    raw = ((a == b) & used).sum(-1) / n
    return (raw - COLLISION) / (1 - COLLISION), 5 * np.sqrt(0.13 / n)


def _sketch(k: int):
    def run(batches):
        for whole in batches:
            for batch in ts.slices_of(whole, lambda b: b.column("doc").field("text")):
                docs = batch.column("doc")
                sets = shingle_sets(*ts.utf8(docs.field("text")), k)
                marks = sketches(sets)
                n = np.array([len(s) for s in sets], np.int64)
                d = np.zeros((2, len(sets)), np.uint64)
                for i, s in enumerate(sets):
                    d[0, i] = s.sum(dtype=np.uint64)
                    d[1, i] = ts.mix(s ^ np.uint64(ts.BASE)).sum(dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(n), pa.array(ts.signed(ts.mix(d[0]))), pa.array(ts.signed(d[1])), pa.array([m.tobytes() for m in marks], pa.binary())],
                    ["doc", "n_shingles", "d1", "d2", "sketch"])
    return run


def _likely(percent: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            est, slack = estimate(x, y)
            yield b.filter(pa.array(est >= percent / 100 - slack)).select(["a", "b"])
    return run


def _alike(k: int, percent: int):
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for whole in batches:
            for b in ts.slices_of(whole, lambda t: t.column("ta")):
                ida, idb = b.column("a").to_pylist(), b.column("b").to_pylist()
                left = shingle_sets(*ts.utf8(b.column("ta")), k)
                new = [i for i, x in enumerate(idb) if x not in held]
                if new:
                    if len(held) > 64:
                        held.clear()
                        new = list(range(len(idb)))
                    first = {idb[i]: i for i in new}
                    held.update(zip(first, shingle_sets(*ts.utf8(b.column("tb").take(pa.array(list(first.values())))), k)))
                keep = []
                for x, h in zip(left, idb):
                    y = held[h]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])
                del ida
    return run


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets, by products of incidence matrices a few thousand hashes at a time."""
    def flat(sets):
        return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (x, i), (y, j) = flat(left), flat(right)
    shared = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), np.float32)
    at = [np.minimum(np.searchsorted(shared, v), max(0, len(shared) - 1)) for v in (x, y)]
    if len(shared):
        ok = [shared[p] == v for p, v in zip(at, (x, y))]
        (p, i), (q, j) = (at[0][ok[0]], i[ok[0]]), (at[1][ok[1]], j[ok[1]])
        for c in range(0, len(shared), COLUMNS):
            parts = []
            for place, owner, n in ((p, i, len(left)), (q, j, len(right))):
                mine = (place >= c) & (place < c + COLUMNS)
                m = np.zeros((n, COLUMNS), np.float32)
                m[owner[mine], place[mine] - c] = 1
                parts.append(m)
            out += parts[0] @ parts[1].T
    return out


def _families(percent: int):
    """Of one block pair of a band: links enough to join all members whose estimates allow one, between components only."""
    def run(rows: pa.Table) -> pa.Table:
        lo, hi = rows["lo"][0].as_py(), rows["hi"][0].as_py()
        s = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        node, label, n, block = (rows[c].to_numpy() for c in ("node", "label", "n", "block"))
        out, joined, right = [], np.arange(len(node)), np.flatnonzero(block == hi)
        for i in np.flatnonzero(block == lo):
            j = right[(label[right] != label[i]) & (joined[right] != joined[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            if len(j):
                est, slack = estimate(s[j], s[i])
                for x in j[est >= percent / 100 - slack]:
                    if joined[x] != joined[i]:
                        out.append((node[i], node[x]))
                        joined[joined == joined[x]] = joined[i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
    return run


def _blocks(k: int, percent: int):
    def run(pdf):
        import pandas as pd
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        sides = [pdf[pdf["block"] == b].sort_values("node") for b in (lo, hi)]
        sets = [[s for at in range(0, len(side), 64) for s in shingle_sets(*ts.utf8(pa.array(side["text"].iloc[at: at + 64], pa.string())), k)] for side in (sides if lo != hi else sides[:1])]
        left, right = sets[0], sets[-1]
        both = common(left, right).astype(np.float64)
        size = [np.array([len(s) for s in x], np.float64) for x in (left, right)]
        linked = 100 * both >= percent * (size[0][:, None] + size[1][None, :] - both)
        label = [side["label"].to_numpy() for side in sides]
        linked &= label[0][:, None] != label[1][None, :]
        node = [side["node"].to_numpy() for side in sides]
        root: dict[int, int] = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(linked)):
            a, b = find(label[0][i]), find(label[1][j])
            if a != b:  # these two components are not yet joined here
                root[max(a, b)] = min(a, b)
                out.append((node[0][i], node[1][j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def _in_blocks(rows: DataFrame, group: str, size) -> DataFrame:
    """Each row once for every pair of blocks of its group that it is part of; a block holds about BLOCK nodes."""
    cut = rows.withColumn("of", F.ceil(size / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    return cut.withColumn("other", F.explode(F.expr("sequence(0, of - 1)"))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of every node."""
    return stored(nodes.select("node").join(components(links), "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """Every row of ``docs`` with its group of near duplicates.

    ``docs`` needs doc_id and text; what else it has comes back inside ``doc``.
    Returns _row (a number per row), doc (the whole input row), doc_id,
    n_shingles, group (number of the group, unique), component_id (smallest
    doc_id of the group) and kept (doc_id is that smallest). Null and empty
    texts are in no group but their own. Rows with equal doc_id are rows of
    their own: equal texts share a group, others do not. A null doc_id is never
    the smallest unless the whole group has none.
    """
    spark = docs.sparkSession
    ts.small_batches(spark)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    kind = packed.schema["doc"].dataType.simpleString()
    base = packed.mapInArrow(_sketch(k), f"doc {kind}, n_shingles long, d1 long, d2 long, sketch binary")
    base = stored(ts.with_row_id(base).withColumn("doc_id", F.col("doc.doc_id")), "sketches")

    nodes = stored(
        base.filter("n_shingles > 0").groupBy("d1", "d2")
        .agg(F.min("_row").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "sets")
    blank = "unhex(repeat('ff', %d))" % (2 * ROWS)
    bands = nodes.select("node", F.explode(F.expr(
        f"filter(transform(sequence(0, {BANDS - 1}), i -> if(substring(sketch, i * {2 * ROWS} + 1, {2 * ROWS}) = {blank}, null,"
        f" xxhash64(i, substring(sketch, i * {2 * ROWS} + 1, {2 * ROWS})))), x -> x is not null)")).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    members = stored(bands.join(shared, "key"), "bands")
    weight = members.groupBy("node").agg(F.sum("c").alias("weight"))
    members = stored(members.join(weight, "node"), "members")

    texts = base.select(F.col("_row").alias("node"), F.col("doc.text").alias("text"))
    hubs = members.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("b"))
    pairs = members.join(hubs, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    sized = nodes.select("node", "n", "sketch")
    pairs = stored(
        pairs.join(sized.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        .join(sized.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        .filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "sa", "sb")
        .mapInArrow(_likely(percent), "a long, b long"), "pairs")
    links = stored(
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        .mapInArrow(_alike(k, percent), "a long, b long"), "links")

    # what bands still hold apart; in a band of two the one pair has been tested
    label = _labels(nodes, links)
    now = members.filter("c > 2").join(label, "node")
    apart = now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    open_ = _in_blocks(now.join(apart, "key").join(sized, "node"), "key", F.col("c"))
    # numbered partitions: small rows that cost much work are not to be merged into few tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    open_ = open_.select("key", "lo", "hi", "block", "node", "label", "n", "sketch").repartition(tasks, "key", "lo", "hi")
    likely = stored(open_.groupBy("key", "lo", "hi").applyInArrow(_families(percent), "a long, b long").distinct(), "likely")
    family = components(likely).withColumnRenamed("label", "family").join(label, "node").select("node", "label", "family")
    family = stored(family, "families")
    sizes = family.groupBy("family").agg(F.count("*").alias("c"))
    placed = _in_blocks(family.join(sizes, "family"), "family", F.col("c")).join(texts, "node")
    placed = placed.select("family", "lo", "hi", "block", "node", "label", "text").repartition(tasks, "family", "lo", "hi")
    more = placed.groupBy("family", "lo", "hi").applyInPandas(_blocks(k, percent), "a long, b long")
    label = _labels(nodes, stored(links.union(more), "all-links"))

    ids = base.join(nodes.select("d1", "d2", "node"), ["d1", "d2"]).join(label, "node").select("_row", "label", "doc_id")
    lowest = ids.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    grouped = ids.select("_row", "label").join(lowest, "label")
    return (
        base.select("_row", "doc", "doc_id", "n_shingles").join(grouped, "_row", "left")
        .withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        .select("_row", "doc", "doc_id", "n_shingles", F.coalesce("label", "_row").alias("group"), "component_id",
                F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def one_per_group(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """The input rows with one row of each group: the smallest doc_id, of equal ones the first row."""
    found = near_duplicates(docs, percent, k)
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("f")).select(F.col("f._row").alias("_row"))
    return found.select("_row", "doc").join(first, "_row", "left_semi").select("doc.*")
