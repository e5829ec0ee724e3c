"""Registered queries: facts, protocols, sentences and formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import amounts as M
from ..functions import facts as X
from ..functions import vocab as V
from ..operators.enrich import native_to_6
from ..sources import testdata as T
from . import frames
from .oracle_views import LIVE_WORDS, sql, texts, values

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return add


@query("fct1_facts", sql(["ctx", "facts"], """
SELECT '0x' || sha256(CAST(o_orderkey AS VARCHAR)) AS tx_hash, coalesce(array_to_string(f.facts, ','), '') AS facts
FROM orders LEFT JOIN facts f ON f.tx_hash = '0x' || sha256(CAST(o_orderkey AS VARCHAR))"""))
def fct1(spark, sf):
    ctx = F.col("ctx")
    return T.tx_ctx(spark, sf).select("tx_hash", F.array_join(X.facts(ctx["selector"], ctx["topics"]), ",").alias("facts"))


@query("fct2_protocol", sql(["ctx", "protocols"], f"""
SELECT o.tx_hash, coalesce(p.protocol, '') AS archive, CASE WHEN p.protocol <> '' THEN p.protocol WHEN c.ctx_to = '{V.USDC}' OR c.selector = '0x' THEN 'USDC' ELSE '' END AS live
FROM (SELECT '0x' || sha256(CAST(o_orderkey AS VARCHAR)) AS tx_hash FROM orders) o LEFT JOIN ctx c ON c.tx_hash = o.tx_hash LEFT JOIN protocols p ON p.tx_hash = o.tx_hash"""))
def fct2(spark, sf):
    """Every transaction; one whose context was not read has no protocol."""
    ctx = F.col("ctx")
    return T.tx_ctx(spark, sf).select("tx_hash", X.protocol(ctx).alias("archive"), X.protocol(ctx, "live").alias("live"))


@query("fct3_bridge_direction", sql(["ctx"], f"""
WITH m AS (SELECT '0x' || sha256(CAST(o_orderkey AS VARCHAR)) AS tx_hash, list_concat([selector], CASE WHEN block_number % 3 = 0 THEN list_append(topics, '{V.FILLED_RELAY}') ELSE topics END) AS marks
  FROM orders LEFT JOIN ctx ON block_number = o_orderkey)
SELECT tx_hash, CASE WHEN list_has_any(marks, {texts(V.BRIDGE_OUT)}) AND NOT list_has_any(marks, {texts(V.BRIDGE_IN)}) THEN 'out'
  WHEN list_has_any(marks, {texts(V.BRIDGE_IN)}) AND NOT list_has_any(marks, {texts(V.BRIDGE_OUT)}) THEN 'in' ELSE '' END AS direction FROM m"""))
def fct3(spark, sf):
    """Every third transaction also logs a fill of a deposit made elsewhere; one that was not read says neither."""
    ctx = F.col("ctx")
    topics = F.when(F.col("block_number") % 3 == 0, F.array_append(ctx["topics"], F.lit(V.FILLED_RELAY))).otherwise(ctx["topics"])
    return T.tx_ctx(spark, sf).select("tx_hash", X.bridge_direction(ctx["selector"], topics).alias("direction"))


_VALUES = "value * CAST(CASE block_number % 4 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 1000 ELSE 100000 END AS DECIMAL(6,0))"


@query("fct4_amount_bucket", sql(["moves"], f"""
WITH m AS (SELECT block_number, log_index, contract_no, CAST({_VALUES} AS HUGEINT) AS value FROM moves),
x AS (SELECT block_number, log_index, contract_no, value AS raw, CAST((value + 999999999999) // 1000000000000 AS HUGEINT) AS value FROM m)
SELECT block_number, log_index, {LIVE_WORDS} AS words, CASE WHEN raw = 0 THEN 'zero T' WHEN contract_no = 2 THEN 'a nonzero amount of T'
  WHEN raw * 100 < 1000000000000000000 THEN 'less than one cent of T' WHEN raw < 1000000000000000000 THEN 'under 1 T'
  WHEN raw < 100000000000000000000 THEN '1 to 100 T' WHEN raw < 10000000000000000000000 THEN '100 to 10,000 T' ELSE 'over 10,000 T' END AS bucket FROM x"""))
def fct4(spark, sf):
    """Values spread over all buckets by powers of ten."""
    times = F.element_at(F.array(*[F.lit(str(k)).cast("decimal(6,0)") for k in (1, 10, 1000, 100000)]), (F.col("block_number") % 4 + 1).cast("int"))
    x = T.moves(spark, sf).withColumn("value", (F.col("value") * times).cast("decimal(38,0)"))
    return x.select("block_number", "log_index", M.amount_words(native_to_6(F.col("value"))).alias("words"),
                    M.amount_bucket(F.col("value"), F.lit("T"), frames.by_contract(frames.DECIMALS)).alias("bucket"))


@query("fct5_plain", sql(["described0"], "SELECT block_number, log_index, plain FROM described0"))
def fct5(spark, sf):
    ctx = F.col("ctx")
    x = frames.events(spark, sf).join(T.tx_ctx(spark, sf).select("tx_hash", "ctx"), "tx_hash", "left")
    return x.select("block_number", "log_index", X.is_plain(ctx, X.facts(ctx["selector"], ctx["topics"]), F.col("contract_address")).alias("plain"))


@query("fct6_call_phrase", sql(["described0"], "SELECT block_number, log_index, called_phrase AS phrase FROM described0"))
def fct6(spark, sf):
    ctx = F.col("ctx")
    from ..operators.sentences import with_calls
    x = frames.events(spark, sf).join(T.tx_ctx(spark, sf).select("tx_hash", "ctx"), "tx_hash", "left")
    return with_calls(x, frames.functions(spark)).select("block_number", "log_index", X.call_phrase(ctx, F.col("fn")).alias("phrase"))


@query("fct7_lane_sentence", sql(["described"], "SELECT block_number, log_index, sentence, protocol FROM described"))
def fct7(spark, sf):
    return frames.described(spark, sf).select("block_number", "log_index", "sentence", "protocol")


@query("fct8_story_sentence", sql(["live"], "SELECT block_number, log_index, story AS family, story, text FROM live"))
def fct8(spark, sf):
    return frames.live(spark, sf).select("block_number", "log_index", "story", "family", "text")


@query("fct9_ruled_lane", sql(["described", "live"], """
SELECT 'archive' AS profile, block_number, log_index, ruled FROM described UNION ALL SELECT 'live', block_number, log_index, ruled FROM live"""))
def fct9(spark, sf):
    a = frames.described(spark, sf).select(F.lit("archive").alias("profile"), "block_number", "log_index", "ruled")
    return a.unionByName(frames.live(spark, sf).select(F.lit("live").alias("profile"), "block_number", "log_index", "ruled"))


_LANE_ROWS = [(i, f, lane) for i, (f, lane) in enumerate(V.FACT_LANES)]


@query("fct10_fact_lane", sql(["live"], f"""
WITH p AS (SELECT * FROM {values(_LANE_ROWS, 'pri', 'fact', 'lane')}),
x AS (SELECT block_number, log_index, plain, unnest(CASE WHEN len(facts) = 0 THEN [''] ELSE facts END) AS fact FROM live)
SELECT block_number, log_index, coalesce(arg_min(p.lane, p.pri), CASE WHEN bool_or(plain) THEN 'payment' END) AS lane
FROM x LEFT JOIN p ON p.fact = x.fact GROUP BY 1, 2"""))
def fct10(spark, sf):
    return frames.live(spark, sf).select("block_number", "log_index", X.fact_lane(F.col("facts"), F.col("plain")).alias("lane"))


def _group_sql(digits: str) -> str:
    return f"ltrim(reverse(regexp_replace(reverse({digits}), '(\\d{{3}})', '\\1,', 'g')), ',')"


_DEC = "CAST(v AS DECIMAL(38,0))"
_ABS = "abs(v)"


@query("fct11_unit_formatting", sql(["moves"], f"""
WITH m AS (SELECT block_number, log_index, l_partkey, CASE WHEN block_number % 3 = 0 THEN -CAST(value AS HUGEINT) ELSE CAST(value AS HUGEINT) END AS v, tx_hash, from_addr FROM moves),
s AS (SELECT *, {_ABS} // 1000000000000000000 AS whole, {_ABS} % 1000000000000000000 AS rest, v < 0 AS neg FROM m),
c AS (SELECT *, (({_ABS} + 5000000000000000) // 10000000000000000) AS cents, (({_ABS} + 500000000000000000) // 1000000000000000000) AS units,
  CASE WHEN l_partkey % 3 = 0 THEN l_partkey * 25 ELSE l_partkey END AS fee FROM s),
f AS (SELECT *, CASE WHEN cents = 0 AND v <> 0 THEN '<0.01' WHEN cents = 0 THEN '0.00' ELSE
  {_group_sql("CAST(cents // 100 AS VARCHAR)")} || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS body FROM c)
SELECT block_number, log_index,
  CASE WHEN neg THEN '-' ELSE '' END || CAST(whole AS VARCHAR) || CASE WHEN rest = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(rest AS VARCHAR), 18, '0'), '0') END AS exact,
  CASE WHEN neg AND v <> 0 THEN '−' ELSE '' END || body AS amount,
  CASE WHEN neg AND units > 0 THEN '−' ELSE '' END || {_group_sql("CAST(units AS VARCHAR)")} AS whole,
  CASE WHEN v = 0 THEN '0.00' WHEN neg THEN '−' || body ELSE '+' || body END AS signed,
  CASE WHEN neg THEN '−' ELSE '' END || {_group_sql("CAST(abs(v) AS VARCHAR)")} AS raw,
  CASE WHEN fee % 1250 = 0 AND fee % 100 = 50 THEN printf('%.2f', (fee + 1) / 10000.0::DOUBLE) ELSE printf('%.2f', fee::DOUBLE / 10000.0::DOUBLE) END || '%' AS fee,
  CAST(floor((200 * log_index + 7) / 14.0) AS BIGINT) AS pct,
  left(from_addr, 6) || '…' || right(from_addr, 4) AS addr, left(tx_hash, 10) || '…' || right(tx_hash, 6) AS hash
FROM f"""))
def fct11(spark, sf):
    """A third of the amounts is negative; fees include the exact half-way cases."""
    x = T.moves(spark, sf).withColumn("v", F.when(F.col("block_number") % 3 == 0, -F.col("value")).otherwise(F.col("value")))
    x = x.withColumn("dec", M.units_to_decimal(F.col("v"), 18))
    fee = F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey") * 25).otherwise(F.col("l_partkey"))
    dec = F.col("dec")
    return x.select("block_number", "log_index", dec.alias("exact"), M.fmt_amount(dec).alias("amount"), M.fmt_whole(dec).alias("whole"),
                    M.fmt_signed(dec).alias("signed"), M.fmt_int(F.col("v")).alias("raw"), M.fmt_fee(fee).alias("fee"),
                    M.pct(F.col("log_index"), F.lit(7)).alias("pct"), M.short_address(F.col("from_addr")).alias("addr"), M.short_hash(F.col("tx_hash")).alias("hash"))


@query("fct12_validation", r"""
WITH i AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN '  0X' || lpad(CAST(c_custkey AS VARCHAR), 40, 'A') || ' '
    WHEN 2 THEN '0x' || sha256(c_name) WHEN 3 THEN '0x' || sha256(c_name) || 'f' WHEN 4 THEN CAST(c_custkey AS VARCHAR) || '-' || CAST(c_custkey % 9 AS VARCHAR)
    ELSE CAST(c_custkey AS VARCHAR) || '-' END AS input FROM customer), v AS (SELECT *, lower(trim(input)) AS t FROM i)
SELECT c_custkey, CASE WHEN regexp_full_match(t, '0x[0-9a-f]{64}') THEN t END AS hash, CASE WHEN regexp_full_match(t, '0x[0-9a-f]{40}') THEN t END AS address,
  CASE WHEN c_custkey % 6 = 4 THEN c_custkey END AS before_block, CASE WHEN c_custkey % 6 = 4 THEN CAST(c_custkey % 9 AS INTEGER) END AS before_log FROM v""")
def fct12(spark, sf):
    k = F.col("c_custkey")
    text = (
        F.when(k % 6 == 0, F.col("c_name")).when(k % 6 == 1, F.concat(F.lit("  0X"), F.lpad(k.cast("string"), 40, "A"), F.lit(" ")))
        .when(k % 6 == 2, F.concat(F.lit("0x"), F.sha2("c_name", 256))).when(k % 6 == 3, F.concat(F.lit("0x"), F.sha2("c_name", 256), F.lit("f")))
        .when(k % 6 == 4, F.concat_ws("-", k.cast("string"), (k % 9).cast("string"))).otherwise(F.concat(k.cast("string"), F.lit("-")))
    )
    x = T.table(spark, sf, "customer").withColumn("input", text)
    b = M.parse_before(F.col("input"))
    return x.select("c_custkey", M.parse_hash(F.col("input")).alias("hash"), M.parse_address(F.col("input")).alias("address"),
                    b["block"].alias("before_block"), b["li"].alias("before_log"))


@query("fct13_known_names", sql(["moves", "ctx"], f"""
WITH n AS (SELECT * FROM {values(list(V.KNOWN_NAMES.items()), 'address', 'name')})
SELECT m.block_number, m.log_index, f.name AS from_name, t.name AS to_name, c.name AS called_name FROM moves m
LEFT JOIN ctx x ON x.tx_hash = m.tx_hash LEFT JOIN n f ON f.address = m.from_addr LEFT JOIN n t ON t.address = m.to_addr LEFT JOIN n c ON c.address = x.ctx_to"""))
def fct13(spark, sf):
    x = T.moves(spark, sf).join(T.tx_ctx(spark, sf).select("tx_hash", "ctx.to"), "tx_hash", "left")
    return x.select("block_number", "log_index", X.known_name(F.col("from_addr")).alias("from_name"),
                    X.known_name(F.col("to_addr")).alias("to_name"), X.known_name(F.upper("to")).alias("called_name"))
