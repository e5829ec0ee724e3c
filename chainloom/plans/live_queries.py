"""Registered queries: streams and live figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import hash_score
from ..session import new_folder
from ..sources import testdata as T
from ..streaming import live as S
from ..streaming.jobs import drain, drain_closed
from ..sources.logs import stream_logs
from . import frames
from .archive_queries import ingested, num
from .explore_queries import _name
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


def closing_row(spark, sf):
    """A row a month after the last event, with an id no event has."""
    e = T.table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("bigint").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(0).cast("bigint").alias("user_id"),
        F.lit("close").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    return last.select(*e.columns)


def ev_stream(source):
    return T.ev_columns(source())


DAY = 86400


@query("str1_rolling_minute", sql(["ev"], f"""
WITH s AS (SELECT *, CAST(floor(epoch(t)) AS BIGINT) AS sec FROM ev), e AS (SELECT max(sec) AS newest, min(sec) AS first FROM s),
r AS (SELECT s.*, e.newest, e.first FROM s, e WHERE sec > newest - {DAY}),
x AS (SELECT tx_hash, unnest(arg_min(struct_pack(li := log_index, b := block_number, s := sec, f0 := from_addr, t0 := to_addr, l := lane), (-value, block_number, log_index))), max(value) AS v, min((block_number, log_index)) AS f FROM r GROUP BY 1),
l AS (SELECT string_agg(tx_hash || ' ' || CAST(li AS VARCHAR) || ' ' || CAST(v AS VARCHAR) || ' ' || CAST(b AS VARCHAR) || ' ' || CAST(s AS VARCHAR) || ' ' || f0 || ' ' || {_name('f0')}
    || ' ' || t0 || ' ' || {_name('t0')} || ' ' || coalesce(l, '-'), ',' ORDER BY v DESC, f) AS largest FROM (SELECT * FROM x ORDER BY v DESC, f LIMIT 5)),
n AS (SELECT string_agg(lane || '=' || CAST(n AS VARCHAR), ',' ORDER BY lane) AS lanes FROM (SELECT lane, count(*) AS n FROM r WHERE lane IS NOT NULL GROUP BY 1)),
a AS (SELECT count(*) AS count, sum(value) AS total, max(sec) AS head_t, greatest(1, least({DAY}, any_value(newest) - any_value(first))) AS span FROM r)
SELECT count, CAST(total // 1000000 AS VARCHAR) || CASE WHEN total % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(total % 1000000 AS VARCHAR), 6, '0'), '0') END AS usdc,
  floor(count / span * 10 + 0.5) / 10 AS per_sec, head_t, (SELECT lanes FROM n) AS lanes, (SELECT largest FROM l) AS largest FROM a"""))
def str1(spark, sf):
    """As of the newest event; the supplied stream is sparse, so the span is a day."""
    rows = T.ev(spark, sf).withColumn("sec", F.unix_timestamp("t"))
    x = S.rolling_minute(rows, span=DAY, decimals=6)
    lanes = F.array_join(F.transform("lanes", lambda s: F.concat_ws("=", s["lane"], s["n"].cast("string"))), ",")
    def leg(s):
        numbers = [s[c].cast("string") for c in ("li", "value", "block_number", "sec")]
        return F.concat_ws(" ", s["tx_hash"], *numbers, s["from_addr"], F.coalesce(s["from_name"], F.lit("")), s["to_addr"],
                           F.coalesce(s["to_name"], F.lit("")), F.coalesce(s["lane"], F.lit("-")))
    largest = F.array_join(F.transform("largest", leg), ",")
    return x.select("count", "usdc", "per_sec", "head_t", lanes.alias("lanes"), largest.alias("largest"))


@query("str2_event_rate", sql(["ev"], """
WITH b AS (SELECT CAST(floor(epoch(t)) AS BIGINT) AS sec, count(*) AS n FROM ev GROUP BY 1),
w AS (SELECT sec, CAST(sum(n) OVER (ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS BIGINT) AS n, min(sec) OVER () AS since FROM b)
SELECT sec, n, round(n / least(3600, greatest(sec - since, 1)), 6) AS rate FROM w"""))
def str2(spark, sf):
    """Second buckets come out of the stream, the trailing hour is summed on reading."""
    buckets = drain_closed(spark, f"{sf}/events.parquet", closing_row(spark, sf), lambda src: S.second_buckets(ev_stream(src).filter("event_id >= -1")), "rate")
    return S.event_rate(buckets, 3600).select("sec", "n", F.round("rate", 6).alias("rate"))


@query("str3_hold_join", sql(["ev"], """
SELECT event_id, block_number, log_index, CASE WHEN user_id % 12 <= 8 THEN lane END AS lane FROM ev"""))
def str3(spark, sf):
    """Lanes follow their row by up to eleven seconds; those later than eight are not waited for."""
    def build(src):
        lanes = ev_stream(src).filter("lane IS NOT NULL OR event_id = -1").withColumn(
            "lane_t", F.col("t") + F.make_dt_interval(secs=(F.col("user_id") % 12).cast("decimal(18,6)")))
        events = ev_stream(src).select("event_id", "block_number", "log_index", "t")
        return S.hold_join(events, lanes).select("event_id", "block_number", "log_index", "lane")
    return drain_closed(spark, f"{sf}/events.parquet", closing_row(spark, sf), build, "hold").filter("event_id >= 0")


@query("str4_lane_volume", sql(["ev"], """
WITH l AS (SELECT CAST(floor(epoch(t) / 600) * 600 AS BIGINT) AS start, tx_hash, lane, max(value) AS v FROM ev GROUP BY ALL)
SELECT start, lane, CAST(sum(v) AS VARCHAR) AS value FROM l GROUP BY 1, 2"""))
def str4(spark, sf):
    def build(src):
        return S.lane_volume(ev_stream(src).select("t", "tx_hash", "lane", "value"), 600, "1 minute")
    last = closing_row(spark, sf).select(F.unix_timestamp(F.col("ts").cast("timestamp"))).scalar()
    out = drain_closed(spark, f"{sf}/events.parquet", closing_row(spark, sf), build, "volume")
    return out.filter(F.col("start") < last - 600).select("start", "lane", num("value"))


@query("str5_collapse_families", """
SELECT sha256(text) AS family, count(*) AS count, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source FROM documents GROUP BY text""")
def str5(spark, sf):
    """Copies of a text are one family; the text itself is not shuffled, its digest is."""
    docs = T.table(spark, sf, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("family"))
    return S.collapse_families(docs, "family", "doc_id", ["doc_id", "lang", "source"])


@query("str5_collapse_stream", ORACLE["str5_collapse_families"])
def str5_stream(spark, sf):
    """The same over a stream of files, collapsed batch by batch."""
    path = f"{new_folder(spark, 'texts')}/documents"
    T.table(spark, sf, "documents").repartition(4).write.parquet(path)
    stream = stream_logs(spark, path, T.table(spark, sf, "documents").schema, max_files=1).select(
        "doc_id", "lang", "source", F.sha2("text", 256).alias("family"))
    return S.collapse_stream(stream, new_folder(spark, "families"), "family", "doc_id", ["doc_id", "lang", "source"])


@query("str6_counters", sql(["live_scored"], """
WITH b AS (SELECT *, block_number // 1000 AS batch_id FROM live_scored), f AS (SELECT sentence, min(batch_id) AS batch_id FROM b WHERE ruled = '' GROUP BY 1),
a AS (SELECT batch_id, count(*) AS n FROM f GROUP BY 1), u AS (SELECT batch_id, count(*) AS rows FROM b WHERE ruled = '' GROUP BY 1)
SELECT batch_id, 'classified' AS name, lane, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT batch_id, 'received', '', count(*) FROM b GROUP BY ALL
UNION ALL SELECT u.batch_id, 'asked', '', coalesce(a.n, 0) FROM u LEFT JOIN a ON a.batch_id = u.batch_id
UNION ALL SELECT u.batch_id, 'reused', '', u.rows - coalesce(a.n, 0) FROM u LEFT JOIN a ON a.batch_id = u.batch_id"""))
def str6(spark, sf):
    rows = frames.live_scored(spark, sf, frames.PLACE).select("ruled", "sentence", "lane", F.floor(F.col("block_number") / 1000).alias("batch_id"))
    return S.counters(rows)


@query("str6_ingest_counters", sql(["moves_raw"], """
WITH k AS (SELECT block_number, log_index, any_value(from_addr) AS f, any_value(block_number % 10 IN (1, 2, 3, 4)) AS bad FROM moves_raw GROUP BY 1, 2),
r AS (SELECT from_addr AS a FROM moves_raw WHERE block_number % 10 NOT IN (1, 2, 3, 4) UNION
  SELECT to_addr FROM (SELECT * FROM moves_raw WHERE block_number % 10 NOT IN (1, 2, 3, 4)
    QUALIFY row_number() OVER (PARTITION BY block_number, log_index ORDER BY CASE WHEN block_number % 10 = 5 THEN 0 ELSE value END, to_addr) = 1))
SELECT 'received' AS name, (SELECT count(*) FROM moves_raw) AS n UNION ALL SELECT 'inserted', (SELECT count(*) FROM k WHERE NOT bad)
UNION ALL SELECT 'dead_letters', (SELECT count(*) FROM k WHERE bad) UNION ALL SELECT 'blocks', (SELECT count(DISTINCT block_number) FROM k WHERE NOT bad)
UNION ALL SELECT 'addresses', (SELECT count(*) FROM r)"""))
def str6_ingest(spark, sf):
    """What the stream into the archive counted, read from its commits, after the stream was sent twice."""
    return ingested(spark, sf, times=2).counters()


@query("str7_feed_state", """
WITH e AS (SELECT user_id, CASE WHEN user_id % 5 <> 0 THEN epoch_us(ts) END AS us FROM events), n AS (SELECT max(epoch_us(ts)) AS now, min(epoch_us(ts)) AS started FROM events),
l AS (SELECT user_id, max(us) AS last FROM e GROUP BY 1)
SELECT user_id, round(CASE WHEN last IS NOT NULL THEN (now - last) / 1000000.0::DOUBLE END, 1) AS age, now - coalesce(last, started) <= 7200 * 1000000::BIGINT AS alive FROM l, n""")
def str7(spark, sf):
    """One feed per user; every fifth has not delivered anything."""
    e = T.table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    now, started = e.agg(F.max("us")).scalar(), e.agg(F.min("us")).scalar()
    rows = e.select("user_id", F.when(F.col("user_id") % 5 != 0, F.col("us")).alias("seen_us"))
    return S.feed_state(rows, "user_id", now, started, 7200)


@query("str8_dedup_stream", sql(["ev"], "SELECT block_number, log_index, event_id, CAST(value AS VARCHAR) AS value FROM ev"))
def str8(spark, sf):
    """The stream with all its rows delivered twice."""
    schema = T.table(spark, sf, "events").schema
    def one():
        return T.ev_columns(stream_logs(spark, f"{sf}/events.parquet", schema))
    out = drain(spark, S.dedup_stream(one().unionByName(one()), ["block_number", "log_index"], "2 days"), "dedup")
    return out.select("block_number", "log_index", "event_id", num("value"))


_P = "(CAST('0x' || substr(sha1({}), 1, 8) AS BIGINT) % 10000) / 10000.0::DOUBLE"
_LOGIT = "ln(least(greatest(p, 0.0001), 0.9999) / (1 - least(greatest(p, 0.0001), 0.9999)))"


@query("str9_rank_question", f"""
WITH a AS (SELECT 'f' || CAST(doc_id // 2 AS VARCHAR) AS family, {_P.format("'fee?' || CAST(doc_id AS VARCHAR)")} AS p, doc_id AS ord FROM labels),
j AS (SELECT family, min(ord) AS first, arg_max(p, ord) AS p FROM a GROUP BY 1 ORDER BY 2 DESC LIMIT 300),
x AS (SELECT *, count(*) OVER () AS size, row_number() OVER (ORDER BY p DESC, first) AS hi, row_number() OVER (ORDER BY p, first DESC) AS lo FROM j),
g AS (SELECT *, avg({_LOGIT}) FILTER (WHERE hi <= greatest(3, floor(size / 10 + 0.5))) OVER () - avg({_LOGIT}) FILTER (WHERE lo <= greatest(3, floor(size / 10 + 0.5))) OVER () AS gap FROM x),
v AS (SELECT *, CASE WHEN gap >= 2.4 THEN 'sorted' WHEN gap >= 1.0 THEN 'weak' ELSE 'flat' END AS verdict FROM g WHERE size >= 12)
SELECT family, p, size, round(gap, 6) AS gap, verdict, 'yes' AS side, CAST(hi AS INTEGER) AS place FROM v WHERE hi <= 5
UNION ALL SELECT family, p, size, round(gap, 6), verdict, 'no', CAST(lo AS INTEGER) FROM v WHERE lo <= 5""")
def str9(spark, sf):
    lab = T.table(spark, sf, "labels")
    d = F.col("doc_id")
    answers = lab.select(F.concat(F.lit("f"), F.floor(d / 2).cast("string")).alias("family"), hash_score(F.concat(F.lit("fee?"), d.cast("string"))).alias("p"), d.alias("ord"))
    return S.rank_question(answers).withColumn("gap", F.round("gap", 6))


@query("str10_pick_questions", """
WITH p AS (SELECT text AS question, min(item_id) AS ord FROM benchmark GROUP BY 1), s AS (SELECT 'r' || substr(sha1(question), 1, 10) AS slot, question, ord FROM p),
d AS (SELECT slot, ord * 7919 % 1000 AS served FROM s WHERE ord % 8 <> 1)
SELECT s.slot, s.question FROM s LEFT JOIN d ON d.slot = s.slot ORDER BY served NULLS FIRST, ord LIMIT 8""")
def str10(spark, sf):
    b = T.table(spark, sf, "benchmark").select(F.col("text").alias("question"), F.col("item_id").alias("ord"))
    pending = b.unionByName(b)  # two viewers ask each question
    served = b.filter("ord % 8 <> 1").select(S.slot_name(F.col("question")).alias("slot"), (F.col("ord") * 7919 % 1000).alias("at"))
    return S.pick_questions(pending, served)
