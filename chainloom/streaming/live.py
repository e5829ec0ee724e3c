"""Live figures: the rolling minute, rates, volumes, held rows and what is asked next.

Rows are transfers with ``t`` (event time). Functions named for streams take a
streaming frame; the others work on a table, as the reading side of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import units_to_decimal
from ..functions.bigint import negated
from ..functions.facts import known_name
from ..operators.ranking import trailing_sum
from ..session import stored
from .jobs import each_batch

BIG = "decimal(38,0)"


def rolling_minute(moves: DataFrame, span: int = 60, decimals: int = 18, top: int = 5) -> DataFrame:
    """One row of figures over ``(newest - span, newest]`` by block time in whole seconds ``sec``.

    Exact sum, rate per second over the time seen, counts per lane, and the
    largest movements with one per transaction (its first largest leg), with
    block, time, parties, their known names and lane.
    """
    newest, first = moves.agg(F.max("sec"), F.min("sec")).first()
    # read for the sums, the lanes and the largest legs
    rows = stored(moves.filter(F.col("sec") > F.lit(newest) - span).select(
        "block_number", "log_index", "tx_hash", "from_addr", "to_addr", "value", "lane", "sec"), "minute")
    order = F.struct("block_number", "log_index")
    leg = F.struct("block_number", F.col("log_index").alias("li"), "sec", "from_addr", known_name(F.col("from_addr")).alias("from_name"),
                   "to_addr", known_name(F.col("to_addr")).alias("to_name"), "value", "lane")
    best = rows.groupBy("tx_hash").agg(F.min_by(leg, F.struct(negated(F.col("value")).alias("v"), order)).alias("b"), F.min(order).alias("first"))
    largest = best.orderBy(F.desc("b.value"), F.asc("first")).limit(top).agg(F.sort_array(F.collect_list(
        F.struct(negated(F.col("b.value")).alias("_v"), "first", "tx_hash", "b.*"))).alias("largest"))
    lanes = rows.filter("lane IS NOT NULL").groupBy("lane").agg(F.count("*").alias("n")).agg(
        F.sort_array(F.collect_list(F.struct("lane", "n"))).alias("lanes"))
    seen = F.greatest(F.lit(1), F.least(F.lit(span), F.lit(newest) - F.lit(first)))
    return rows.agg(F.count("*").alias("count"), F.sum("value").cast(BIG).alias("total"), F.max("sec").alias("head_t")).select(
        "count", units_to_decimal(F.coalesce("total", F.lit(0)).cast(BIG), decimals).alias("usdc"),
        (F.floor(F.col("count") / seen * 10 + 0.5) / 10).alias("per_sec"), lanes.scalar().alias("lanes"), largest.scalar().alias("largest"), "head_t")


def second_buckets(stream: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Counts and exact sums per second of a stream, final once the watermark passes."""
    return (
        stream.withWatermark("t", delay).groupBy(F.window("t", "1 second"))
        .agg(F.count("*").alias("n"), F.sum("value").cast(BIG).alias("value"))
        .select(F.unix_timestamp("window.start").alias("sec"), "n", "value")
    )


def event_rate(buckets: DataFrame, window: int = 60) -> DataFrame:
    """Events per second at every second that has some, over ``[sec - window, sec]`` or the time since the start."""
    since = buckets.agg(F.min("sec")).scalar()
    x = trailing_sum(buckets.select("sec", "n"), "sec", ["n"], window, stretch=max(3600, 10 * window))
    span = F.least(F.lit(window), F.greatest(F.col("sec") - since, F.lit(1)))
    return x.select("sec", F.col("n_sum").alias("n"), (F.col("n_sum") / span).alias("rate"))


def hold_join(events: DataFrame, lanes: DataFrame, hold: str = "8 seconds", delay: str = "10 seconds") -> DataFrame:
    """Stream-stream left join: a row waits for its lane as long as the hold, then goes out without."""
    e = events.withWatermark("t", delay)
    ln = lanes.select(F.col("block_number").alias("_b"), F.col("log_index").alias("_l"), "lane", "lane_t").withWatermark("lane_t", delay)
    on = (F.col("block_number") == F.col("_b")) & (F.col("log_index") == F.col("_l")) & (F.col("lane_t") >= F.col("t")) & (
        F.col("lane_t") <= F.col("t") + F.expr(f"INTERVAL {hold}"))
    return e.join(ln, on, "left_outer").drop("_b", "_l")


def lane_volume(rows: DataFrame, window: int = 600, delay: str | None = None) -> DataFrame:
    """Value per lane and window, each transaction once per lane at its largest leg.

    On a stream (with ``delay``) the two aggregations are chained in append
    mode; the same text on a table gives the same rows.
    """
    src = rows.withWatermark("t", delay) if delay else rows
    width = f"{window} seconds"
    legs = src.groupBy(F.window("t", width), "tx_hash", "lane").agg(F.max("value").alias("value"))
    return (
        legs.groupBy(F.window(F.window_time("window"), width).alias("w"), "lane").agg(F.sum("value").cast(BIG).alias("value"))
        .select(F.unix_timestamp("w.start").alias("start"), "lane", "value")
    )


def collapse_families(batch: DataFrame, family: str, order: str, keep: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows that read the same become one with their count; the first row supplies the other columns."""
    first = F.min_by(F.struct(*keep), order).alias("_first")
    return batch.groupBy(*(by or []), family).agg(F.count("*").alias("count"), first).select(*(by or []), family, "count", "_first.*")


def collapse_stream(stream: DataFrame, root: str, family: str, order: str, keep: list[str]) -> DataFrame:
    """Families of a stream: every micro-batch is collapsed to a folder of its own, and the batches' families are merged on reading.

    A replayed batch rewrites its folder, so nothing is counted twice.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        collapse_families(batch, family, order, keep).write.mode("overwrite").parquet(f"{root}/families/batch_id={batch_id}")

    each_batch(stream, root, handle)
    parts = stream.sparkSession.read.parquet(f"{root}/families")
    first = F.min_by(F.struct(*keep), order).alias("_first")
    return parts.groupBy(family).agg(F.sum("count").alias("count"), first).select(family, "count", "_first.*")


def counters(rows: DataFrame, by: str = "batch_id") -> DataFrame:
    """Counter rows (name, lane, n) per batch: received, classified per lane, asked and reused.

    A sentence is asked in the first batch it occurs in; every other unruled
    row that bears it reuses the answer.
    """
    lanes = rows.groupBy(by, "lane").agg(F.count("*").alias("n")).select(by, F.lit("classified").alias("name"), "lane", "n")
    none = F.lit("").alias("lane")
    received = rows.groupBy(by).agg(F.count("*").alias("n")).select(by, F.lit("received").alias("name"), none, "n")
    unruled = rows.filter("ruled = ''")
    first = unruled.groupBy("sentence").agg(F.min(by).alias(by))
    asked = first.groupBy(by).agg(F.count("*").alias("n"))
    judged = unruled.groupBy(by).agg(F.count("*").alias("rows")).join(asked, by, "left")
    n = F.coalesce("n", F.lit(0))
    pairs = F.inline(F.array(F.struct(F.lit("asked").alias("name"), n.alias("n")), F.struct(F.lit("reused").alias("name"), (F.col("rows") - n).alias("n"))))
    return lanes.unionByName(received).unionByName(judged.select(by, pairs).select(by, "name", none, "n"))


def observed(stream: DataFrame, name: str) -> DataFrame:
    """The same stream with its row counts reported to listeners, without another pass."""
    return stream.observe(name, F.count(F.lit(1)).alias("received"), F.count("lane").alias("classified"))


def feed_state(rows: DataFrame, by: str, now: Column, started: Column, stale: int = 120) -> DataFrame:
    """Age of each feed's last row and whether it is alive; before the first row age counts from the start.

    ``rows`` has ``seen_us`` (microseconds, null when nothing came); now and started are microseconds too.
    """
    last = rows.groupBy(by).agg(F.max("seen_us").alias("_last"))
    since = now - F.coalesce("_last", started)
    age = F.when(F.col("_last").isNotNull(), F.round((now - F.col("_last")) / 1e6, 1))
    return last.select(by, age.alias("age"), (since <= stale * 1_000_000).alias("alive"))


def watch_feeds(stream: DataFrame, stale: float = 120) -> DataFrame:
    """A row (feed, alive, last) whenever a feed of a stream comes alive or has been silent for ``stale`` seconds.

    ``stream(feed, seen)``: ``seen`` is when the row came, null for a row that
    only names a feed, which starts its grace. ``last`` is the latest seen so
    far. Silence is measured by the clock, so it is told without any further
    row; deadlines are part of the state and outlive a restart. A feed costs a
    state of three numbers.
    """
    import pandas as pd

    grace = int(stale * 1000)

    def turn(key, batches, state):
        now = state.getCurrentProcessingTimeMs()
        alive, last, deadline = state.get if state.exists else (None, None, None)
        before = alive
        if state.hasTimedOut:
            alive = False
        else:
            news = [m for m in (b["seen_us"].max() for b in batches) if pd.notna(m)]
            if news or before is None:
                alive, deadline = True, now + grace
                last = max([int(m) for m in news] + ([last] if last is not None else []), default=None)
        state.update((alive, last, deadline))
        if alive:  # a call clears the timer
            state.setTimeoutDuration(max(1, deadline - now))
        if alive != before:
            yield pd.DataFrame({"feed": [key[0]], "alive": [alive], "last_us": pd.array([last], "Int64")})

    kind = dict(stream.dtypes)["feed"]
    told = stream.filter("feed is not null").select("feed", F.unix_micros(F.col("seen").cast("timestamp")).alias("seen_us")).groupBy("feed").applyInPandasWithState(
        turn, f"feed {kind}, alive boolean, last_us long", "alive boolean, last long, deadline long", "append", "ProcessingTimeTimeout")
    return told.select("feed", "alive", F.timestamp_micros("last_us").alias("last"))


def dedup_stream(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Rows whose key was not seen within the delay; the state held is bounded by it."""
    return stream.withWatermark("t", delay).dropDuplicatesWithinWatermark(keys)


def logit(p: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.ln(c / (1 - c))


def rank_question(answers: DataFrame, n: int = 300, ends: int = 5, least: int = 12) -> DataFrame:
    """The two ends of a question's answers over the latest n families, with the log-odds gap between them.

    ``answers(family, p, ord)``. Rows (side, place, family, p) of both ends
    carry the gap of the outer tenths and its verdict; nothing below ``least`` families.
    """
    judged = answers.groupBy("family").agg(F.min("ord").alias("first"), F.max_by("p", "ord").alias("p"))
    pool = judged.orderBy(F.desc("first")).limit(n)
    # at most n rows from here on
    whole = Window.partitionBy()
    high, low = Window.orderBy(F.desc("p"), F.asc("first")), Window.orderBy(F.asc("p"), F.desc("first"))
    x = pool.withColumn("size", F.count("*").over(whole)).withColumn("hi", F.row_number().over(high)).withColumn("lo", F.row_number().over(low))
    edge = F.greatest(F.lit(3), F.floor(F.col("size") / 10 + 0.5))

    def mean(place):
        return F.avg(F.when(F.col(place) <= edge, logit(F.col("p")))).over(whole)
    x = x.filter(F.col("size") >= least).withColumn("gap", mean("hi") - mean("lo"))
    x = x.withColumn("verdict", F.when(F.col("gap") >= 2.4, "sorted").when(F.col("gap") >= 1.0, "weak").otherwise("flat"))
    sides = F.inline(F.filter(F.array(
        F.struct(F.lit("yes").alias("side"), F.col("hi").alias("place")), F.struct(F.lit("no").alias("side"), F.col("lo").alias("place"))),
        lambda s: s["place"] <= ends))
    return x.select("family", "p", "size", "gap", "verdict", sides)


def slot_name(question: Column) -> Column:
    return F.concat(F.lit("r"), F.substring(F.sha1(question), 1, 10))


def pick_questions(pending: DataFrame, served: DataFrame, n: int = 8) -> DataFrame:
    """At most n distinct questions, the longest unserved first; equal waits keep the order of asking.

    ``pending(question, ord)``, ``served(slot, at)``.
    """
    distinct = pending.groupBy("question").agg(F.min("ord").alias("ord")).withColumn("slot", slot_name(F.col("question")))
    x = distinct.join(served, "slot", "left").orderBy(F.asc_nulls_first("at"), "ord").limit(n)
    return x.select("slot", "question")
