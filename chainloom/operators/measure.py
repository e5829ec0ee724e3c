"""Latencies, rates and speeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import global_rank


def latency_stats(df: DataFrame, col: str, tie: list[str]) -> DataFrame:
    """count, min, nearest-rank p50, p90, p99 and max of a column, exactly.

    The values are ranked by a distributed sort and only the wanted ranks are
    read; no task holds them all. ``tie`` makes the order total.
    """
    ranked = global_rank(df.select(col, *[c for c in tie if c != col]), [col, *[c for c in tie if c != col]])
    n = ranked.agg(F.count("*")).scalar()

    def at(p):
        return F.greatest(F.least(n - 1, F.ceil(F.lit(p / 100) * n) - 1), F.lit(0))
    picks = {"min": F.lit(0), "p50": at(50), "p90": at(90), "p99": at(99), "max": n - 1}
    return ranked.agg(F.count("*").alias("count"), *[F.max(F.when(F.col("rank") == r, F.col(col))).alias(k) for k, r in picks.items()])


def rate(units: Column, ms: Column) -> Column:
    """Units per second; 0 for no time."""
    return F.when(ms > 0, units * 1000 / ms).otherwise(0.0)


def freshness(blocks: DataFrame) -> DataFrame:
    """Whole milliseconds from block time to ingest, one sample per block."""
    us = F.unix_micros("_ingested_at") - F.unix_micros("block_time")
    return blocks.select("block_number", F.floor((us + 500) / 1000).cast("bigint").alias("ms"))


def backfill_speed(samples: DataFrame, blocks: DataFrame, by: str) -> DataFrame:
    """Blocks and events per second of wall time, and chain seconds covered per wall second.

    ``samples(by, block, events, ms)`` are the progress readings of a run,
    ``blocks(by, block_time)`` what it wrote.
    """
    run = samples.groupBy(by).agg(
        (F.max("block") - F.min("block") + 1).alias("blocks"), F.max("events").alias("events"), (F.max("ms") - F.min("ms")).alias("ms"))
    t = blocks.groupBy(by).agg((F.max(F.unix_timestamp("block_time")) - F.min(F.unix_timestamp("block_time"))).alias("chain_s"))

    def one(c):
        return F.floor(rate(F.col(c), F.col("ms")) * 10 + 0.5) / 10
    return run.join(t, by).select(by, "blocks", "events", "ms", one("blocks").alias("blocks_per_s"), one("events").alias("events_per_s"),
                                  "chain_s", rate(F.col("chain_s"), F.col("ms")).alias("speed_up"))


def recent_p95(samples: DataFrame, col: str, order: str, n: int = 200) -> DataFrame:
    """Of the last n samples: the last, the value at floor(0.95 n) and the one at n div 2, in sorted order."""
    last = samples.orderBy(F.desc(order)).limit(n)  # n samples at most from here on
    x = last.agg(F.array_sort(F.collect_list(col)).alias("s"), F.max_by(col, order).alias("last"))
    size = F.size("s")
    return x.select("last", F.get("s", F.least(size - 1, F.floor(size * 0.95).cast("int"))).alias("p95"), F.get("s", F.floor(size / 2).cast("int")).alias("median"))
