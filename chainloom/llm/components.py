"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _print(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(a, b) as decimal(38,0))"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node that can be reached; only nodes with an edge appear.

    ``edges`` has long columns a and b. Each star keeps one row per node and
    smaller neighbour, so a hub's links are sums over tasks (a partial minimum),
    and the join with the unique minima can be split where a hub is hot. Every
    round is a written table; the number of rounds grows with the logarithm of
    the longest path.
    """
    e = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _print(e)
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (
            both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b").distinct()
        )
        large = stored(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                          F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").filter("a <> b").distinct()
        )
        e = stored(small, "small-star")
        now = _print(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
