"""Registered queries: measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import measure as M
from ..sources import testdata as T
from .oracle_views import sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return add


@query("msr1_latency_stats", """
SELECT count(*) AS count, min(value) AS min, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS p90,
  percentile_disc(0.99) WITHIN GROUP (ORDER BY value) AS p99, max(value) AS max FROM events""")
def msr1(spark, sf):
    return M.latency_stats(T.table(spark, sf, "events"), "value", ["event_id"])


@query("msr2_rate", """
SELECT user_id, count(*) AS n, round(CASE WHEN max(epoch_ms(ts)) > min(epoch_ms(ts)) THEN count(*) * 1000 / (max(epoch_ms(ts)) - min(epoch_ms(ts)))::DOUBLE ELSE 0 END, 9) AS rate FROM events GROUP BY 1""")
def msr2(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    x = T.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.max(ms) - F.min(ms)).alias("ms"))
    return x.select("user_id", "n", F.round(M.rate(F.col("n"), F.col("ms")), 9).alias("rate"))


def ingested(spark, sf):
    """Blocks of the event stream, taken in some milliseconds after their time."""
    ev = T.ev(spark, sf).groupBy("block_number").agg(F.min("t").alias("block_time"), F.max("user_id").alias("u"))
    late = F.make_dt_interval(secs=((F.col("u") * 37 % 1700 + 5) / 1000).cast("decimal(18,6)"))
    return ev.select("block_number", "block_time", (F.col("block_time") + late).alias("_ingested_at"))


_LATE = "SELECT block_number, max(user_id) * 37 % 1700 + 5 AS ms, min(t) AS t FROM ev GROUP BY 1"


@query("msr3_freshness", sql(["ev"], f"SELECT block_number, ms FROM ({_LATE})"))
def msr3(spark, sf):
    return M.freshness(ingested(spark, sf))


@query("msr3_freshness_stats", sql(["ev"], f"""
SELECT count(*) AS count, min(ms) AS min, percentile_disc(0.5) WITHIN GROUP (ORDER BY ms) AS p50, percentile_disc(0.9) WITHIN GROUP (ORDER BY ms) AS p90,
  percentile_disc(0.99) WITHIN GROUP (ORDER BY ms) AS p99, max(ms) AS max FROM ({_LATE})"""))
def msr3b(spark, sf):
    return M.latency_stats(M.freshness(ingested(spark, sf)), "ms", ["block_number"])


@query("msr4_backfill_speed", sql(["ev"], """
WITH s AS (SELECT event_type AS run, block_number AS block, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS events, event_id * 3 AS ms, t FROM ev),
r AS (SELECT run, max(block) - min(block) + 1 AS blocks, max(events) AS events, max(ms) - min(ms) AS ms, CAST(floor(epoch(max(t))) - floor(epoch(min(t))) AS BIGINT) AS chain_s FROM s GROUP BY 1)
SELECT run, blocks, events, ms, floor(blocks * 1000 / ms * 10 + 0.5) / 10 AS blocks_per_s, floor(events * 1000 / ms * 10 + 0.5) / 10 AS events_per_s, chain_s,
  round(chain_s * 1000 / ms, 6) AS speed_up FROM r"""))
def msr4(spark, sf):
    """A run per event type; each reading knows how many events came before it."""
    ev = T.ev(spark, sf)
    n = ev.groupBy("event_type").agg(F.count("*").alias("events"))
    samples = ev.select(F.col("event_type").alias("run"), F.col("block_number").alias("block"), (F.col("event_id") * 3).alias("ms"), "event_type").join(n, "event_type")
    x = M.backfill_speed(samples, ev.select(F.col("event_type").alias("run"), F.col("t").alias("block_time")), "run")
    return x.withColumn("speed_up", F.round("speed_up", 6))


@query("msr5_recent_p95", """
WITH l AS (SELECT value, event_id FROM events ORDER BY event_id DESC LIMIT 200), s AS (SELECT list_sort(list(value)) AS s, arg_max(value, event_id) AS last FROM l)
SELECT last, s[CAST(least(len(s) - 1, floor(len(s) * 0.95)) AS BIGINT) + 1] AS p95, s[len(s) // 2 + 1] AS median FROM s""")
def msr5(spark, sf):
    return M.recent_p95(T.table(spark, sf, "events"), "value", "event_id")
