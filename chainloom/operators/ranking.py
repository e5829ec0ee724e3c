"""Ranks and windows that never need one task to hold an unbounded group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def _spread_in_order(df: DataFrame, order: list) -> DataFrame:
    """Rows in range partitions, the partition's number as ``_part``; callers write them once, so that all reads see the same partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Zero-based position of every row in a total order, without a one-task window.

    Range partitioning sorts the data across tasks, each row gets its position
    inside its partition, and the partitions' sizes (one small row each) become
    offsets. The positioned rows are written once so that counting and offsetting
    see the same partitions even when an executor is lost in between.
    ``order`` must be a total order: that is what lets a range split any hot value.
    """
    placed = _spread_in_order(df, order).withColumn(
        "_pos", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("bigint"), 33))
    placed = stored(placed, "rank")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition, so at most n rows: safe to order in one task and to broadcast.
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_pos"))
        .drop("_part", "_pos", "_before")
    )


def total_before(df: DataFrame, order: list, measure: str, name: str = "before") -> DataFrame:
    """Sum of ``measure`` over all rows that come earlier in a total order.

    As ``global_rank``: each range partition sums its own rows, and the sums of
    the partitions before it (one small row each) are added.
    """
    placed = stored(_spread_in_order(df, order), "totals")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part").agg(F.sum(measure).alias("_n"))
    offsets = sums.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_in", F.coalesce(F.sum(measure).over(inside), F.lit(0))).join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")
    )


# log_index is a 31-bit integer and unique within its block, so a group of logs
# cut into pieces of this many holds at most 2^16 rows in a piece and 2^15 pieces.
LOGS_PER_PIECE = 1 << 16


def row_number_by_log(df: DataFrame, keys: list[str], name: str = "rn", log: str = "log_index") -> DataFrame:
    """row_number() over (partition by keys order by log), for groups inside one block.

    The group is cut by log index into pieces of bounded size; a piece's
    predecessors add its offset. No window holds more than 2^16 rows. The rows
    move once, by the first key (a transaction, say), and stay dealt by it: what
    is joined to them comes by that key alone, a map of the others.
    """
    home, rest = keys[0], keys[1:]
    cut = df.repartition(home).withColumn("_piece", F.floor(F.col(log) / LOGS_PER_PIECE))
    sizes = cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.struct(*rest, "_piece")
    # only pieces after the first need an offset, and few groups have one
    offsets = (
        sizes.select(*keys, "_piece", F.sum("_n").over(before).alias("_before"))
        .filter("_piece > 0").groupBy(home).agg(F.map_from_entries(F.collect_list(F.struct(piece.alias("piece"), "_before"))).alias("_offsets"))
    )
    inner = Window.partitionBy(*keys, "_piece").orderBy(log)
    return (
        cut.withColumn("_in", F.row_number().over(inner))
        .join(offsets, home, "left")
        .withColumn(name, F.col("_in") + F.coalesce(F.try_element_at("_offsets", piece), F.lit(0)))
        .drop("_piece", "_in", "_offsets")
    )


GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, spread: int = 1) -> DataFrame:
    """The first ``k`` rows of every key, as row number ``rn``.

    The rank filter is applied map-side before the shuffle, so a hot key sends
    at most k rows per task; Spark does so up to a threshold, which is raised to
    k where it is lower. For a large k, ``spread`` first ranks each key in
    that many slices, so that no single task receives all the hot key's rows.
    """
    conf = df.sparkSession.conf
    if int(conf.get(GROUP_LIMIT)) < k:
        conf.set(GROUP_LIMIT, str(k))
    rows = df
    if spread > 1:
        rows = df.withColumn("_slice", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in keys]), F.lit(spread)))
        part = Window.partitionBy(*keys, "_slice").orderBy(*order)
        rows = rows.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_r", "_slice")
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def trailing_sum(buckets: DataFrame, second: str, measures: list[str], span: int, stretch: int = 3600) -> DataFrame:
    """Sum of each measure over ``[second - span, second]`` for one row per second.

    Time is cut into stretches and the last ``span`` seconds of each are copied
    into the next, so every window partition has at most stretch + span rows.
    """
    home = F.floor(F.col(second) / stretch)
    last = F.floor((F.col(second) + span) / stretch)
    spread = buckets.withColumn("_home", home).withColumn("_stretch", F.explode(F.sequence(home, last)))
    w = Window.partitionBy("_stretch").orderBy(second).rangeBetween(-span, 0)
    out = spread
    for m in measures:
        out = out.withColumn(f"{m}_sum", F.sum(m).over(w))
    return out.filter("_stretch = _home").drop("_stretch", "_home")
