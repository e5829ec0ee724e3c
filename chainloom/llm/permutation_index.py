"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Within a block of
vectors each pivot has an inverted file: the rank it has for every vector of the
block. A query reads the files of its own nearest pivots, adds up the footrule
distance, and the closest candidates are ranked again by the inner product.

Equal vectors are one class with its smallest ids, as many as any answer can
need, so a vector that a third of all rows share is searched once. Blocks of
queries meet blocks of vectors; each pair is one task's bounded work and
returns only its best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import textscan as ts

PIVOTS = 256
LENGTH = 64
BLOCK = 4096
#: A block reranks this many candidates, or this share of its vectors if that is more.
CANDIDATES = 1024
CANDIDATE_SHARE = 0.5


def permutations(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Per row its nearest pivots, nearest first."""
    near = x @ pivots.T
    length = min(length, pivots.shape[0])
    return np.argsort(-near, axis=1, kind="stable")[:, :length]


def inverted_files(order: np.ndarray, pivots: int) -> np.ndarray:
    """Row p: the rank of pivot p for every vector, its length where the pivot is not listed."""
    n, length = order.shape
    files = np.full((pivots, n), length, np.int16)
    files[order, np.arange(n)[:, None]] = np.arange(length, dtype=np.int16)
    return files


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * q[i]
    return total


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _search(pivots: np.ndarray, length: int, candidates: int, k: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, q = _matrix(left["embedding"]), _matrix(right["embedding"])
            files = inverted_files(permutations(x, pivots, length), len(pivots))
            asked = permutations(q, pivots, length)
            place = np.arange(asked.shape[1], dtype=np.int16)[:, None]
            ids = left["ids"].to_numpy()
            most = max(candidates, int(np.ceil(CANDIDATE_SHARE * len(x))))
            for i in range(len(q)):
                if len(x) > most:
                    footrule = np.abs(files[asked[i]] - place).sum(0, dtype=np.int32)
                    near = np.argpartition(footrule, most - 1)[:most]
                else:
                    near = np.arange(len(x))
                rough = x[near] @ q[i]
                if len(near) > k:
                    near = near[rough >= np.partition(rough, len(near) - k)[len(near) - k] - 1e-9]
                score = inner(x[near], q[i])
                best = sorted(((-s, v) for s, j in zip(score, near) for v in ids[j]))[:k]
                out += [(right["class"].iloc[i], v, -s) for s, v in best]
        return pd.DataFrame(out, columns=["class", "vec_id", "score"]).astype({"class": "int64", "vec_id": "int64", "score": "float64"})
    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = PIVOTS, length: int = LENGTH, block: int = BLOCK, candidates: int = CANDIDATES) -> DataFrame:
    """The ``k`` nearest found for every vector whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    Nearness is the inner product, ties go to the smaller vec_id. Vectors that
    are null, zero, or hold a null or non-finite component take no part, nor do
    rows without vec_id or of another length than the first vector's. A row
    repeated with the same id and vector counts once; a query never finds its
    own id.
    """
    spark = vectors.sparkSession
    ok = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
                " and exists(embedding, x -> x <> 0)")
    rows = vectors.select("vec_id", "embedding").filter("vec_id is not null").filter(F.coalesce(ok, F.lit(False)))
    size = rows.agg(F.min_by(F.size("embedding"), "vec_id")).first()[0]
    rows = rows.filter(F.size("embedding") == F.lit(size or 0)).distinct()
    # the k + 1 smallest ids answer for a class, as its ids tie with each other
    first = Window.partitionBy("embedding").orderBy("vec_id")
    classes = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = stored(ts.with_row_id(classes, "class"), "vector-classes")
    chosen = classes.orderBy(F.xxhash64("embedding"), "embedding").limit(pivots).select("embedding").collect()  # the sample that the pivots are
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = np.array([r[0] for r in chosen], np.float64)
    asking = rows.filter(F.col("vec_id") % every == 0).join(classes.select("embedding", "class"), "embedding").select("class", F.col("vec_id").alias("query_id"))
    asking = stored(asking, "queries")
    queries = stored(asking.select("class").distinct().join(classes.select("class", "embedding"), "class"), "query-vectors")
    blocks = max(1, -(-classes.count() // block))
    parts = max(1, -(-asking.count() // block))
    index = classes.withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    wanted = queries.withColumn("part", F.pmod(F.xxhash64("class"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = index.groupBy("block", "part").cogroup(wanted.groupBy("block", "part")).applyInPandas(
        _search(points, length, candidates, k + 1), "class long, vec_id long, score double")
    best = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    top = top.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top"))
    return asking.join(top, "class").select("query_id", F.posexplode(F.expr(f"slice(filter(top, t -> t.vec_id <> query_id), 1, {k})")).alias("i", "t")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))
