"""Registered queries: catalogs, decoding and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.bigint import u256, u256_key, u256_sum
from ..functions.naming import storage_type
from ..operators import catalog as C
from ..operators import decode as D
from ..operators import enrich as E
from ..session import stored
from ..sources import testdata as T
from .archive_queries import TRANSFER_INPUTS, num
from .oracle_views import sql, values

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return add


_IN = '{{"name":"{}","type":"{}","indexed":{}}}'
_ERC20 = ",".join(_IN.format(*p) for p in (("from", "address", "true"), ("to", "address", "true"), ("value", "uint256", "false")))
_ERC721 = ",".join(_IN.format(*p) for p in (("from", "address", "true"), ("to", "address", "true"), ("tokenId", "uint256", "true")))
_SIZE = ",".join(_IN.format(*p) for p in (("blockNumber", "uint64", "false"), ("", "bytes32", "false"),
                                          ("newOwner", "address", "false"), ("HTTPNames", "string[]", "false")))
OTHER_TOPIC = "0xab12" + "0" * 60


def abis(spark, sf):
    """One contract per part, its ABI as JSON: an ERC-20 Transfer, for some an overload, an odd event, a function.

    A megabyte of parts makes some two hundred megabytes of ABIs, so the rows are spread before the texts are made.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = T.table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size").repartition(n, "p_partkey")
    abi = F.concat(
        F.lit('[{"type":"event","name":"Transfer","topic0":"' + V.TRANSFER_TOPIC + '","inputs":[' + _ERC20 + "]},"),
        F.when(F.col("p_size") % 3 == 0, '{"type":"event","name":"Transfer","topic0":"' + OTHER_TOPIC + '","inputs":[' + _ERC721 + "]},").otherwise(""),
        F.lit('{"type":"event","name":"'), F.col("p_type"), F.lit('SizeSet","topic0":"0x'), F.sha2("p_name", 256),
        F.lit('","inputs":[' + _SIZE + ']},{"type":"function","name":"set'), F.col("p_type"), F.lit('","selector":"0x'),
        F.substring(F.sha2(F.concat("p_name", "p_type"), 256), 1, 8), F.lit('"},{"type":"constructor"}]'))
    return p.select(
        F.concat("p_name", F.lit(" V"), F.col("p_partkey").cast("string")).alias("contract"),
        T.padded("0xAB", F.col("p_partkey"), 38).alias("address"), abi.alias("abi"),
        F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("Transfer"))).alias("selected"))


_BASE = "replace(p_name, ' ', '_') || '_v' || CAST(p_partkey AS VARCHAR)"
_EVENTS = f"""
SELECT p_name || ' V' || CAST(p_partkey AS VARCHAR) AS contract, '0xab' || lpad(CAST(p_partkey AS VARCHAR), 38, '0') AS address, e.*
FROM part, LATERAL (
  SELECT 'Transfer' AS event, '{V.TRANSFER_TOPIC}' AS topic0, {_BASE} || '_transfer' || CASE WHEN p_size % 3 = 0 THEN '_ddf2' ELSE '' END AS table_name, 3 AS n_inputs, 1 AS kind
  UNION ALL SELECT 'Transfer', '{OTHER_TOPIC}', {_BASE} || '_transfer_ab12', 3, 2 WHERE p_size % 3 = 0
  UNION ALL SELECT p_type || 'SizeSet', '0x' || sha256(p_name), {_BASE} || '_' || lower(p_type) || '_size_set', 4, 3 WHERE p_partkey % 4 <> 0) e"""


@query("dec1_event_catalog", f"SELECT contract, address, event, topic0, table_name, n_inputs FROM ({_EVENTS})")
def dec1(spark, sf):
    return C.event_catalog(abis(spark, sf)).select("contract", "address", "event", "topic0", "table_name", F.size("inputs").alias("n_inputs"))


@query("dec2_function_catalog", """
SELECT p_name || ' V' || CAST(p_partkey AS VARCHAR) AS contract, '0xab' || lpad(CAST(p_partkey AS VARCHAR), 38, '0') AS address,
  '0x' || substr(sha256(p_name || p_type), 1, 8) AS selector, 'set' || p_type AS name FROM part""")
def dec2(spark, sf):
    return C.function_catalog(abis(spark, sf))


_COLS = [
    (1, 0, "from_id", "from", "address", True), (1, 1, "to_id", "to", "address", True), (1, 2, "value", "value", "uint256", False),
    (2, 0, "from_id", "from", "address", True), (2, 1, "to_id", "to", "address", True), (2, 2, "token_id", "token_id", "uint256", True),
    (3, 0, "param_block_number", "param_block_number", "uint64", False), (3, 1, "arg1", "arg1", "bytes32", False),
    (3, 2, "new_owner_id", "new_owner", "address", False), (3, 3, "http_names", "http_names", "string[]", False),
]


@query("dec3_event_columns", f"""
SELECT table_name, pos, name, view_name, abi_type, indexed FROM ({_EVENTS}) JOIN
(SELECT * FROM {values(_COLS, 'kind', 'pos', 'name', 'view_name', 'abi_type', 'indexed')}) USING (kind)""")
def dec3(spark, sf):
    return C.event_columns(C.event_catalog(abis(spark, sf)))


@query("dec4_storage_type", f"""
SELECT table_name, pos, CASE abi_type WHEN 'address' THEN 'integer' WHEN 'uint256' THEN 'numeric(78,0)' WHEN 'uint64' THEN 'numeric(78,0)'
  WHEN 'bytes32' THEN 'binary' ELSE 'json' END AS storage FROM ({_EVENTS}) JOIN
(SELECT * FROM {values(_COLS, 'kind', 'pos', 'name', 'view_name', 'abi_type', 'indexed')}) USING (kind)""")
def dec4(spark, sf):
    return C.event_columns(C.event_catalog(abis(spark, sf))).select("table_name", "pos", storage_type(F.col("abi_type")).alias("storage"))


@query("dec9_is_transfer", f"SELECT table_name, topic0, kind = 1 AS is_transfer FROM ({_EVENTS})")
def dec9(spark, sf):
    return C.event_catalog(abis(spark, sf)).select("table_name", "topic0", C.is_transfer(F.col("inputs"), F.col("topic0")).alias("is_transfer"))


def _routes(spark):
    return spark.createDataFrame(
        [("usdc", V.USDC, "Transfer", V.TRANSFER_TOPIC, "usdc_transfer"), ("mystery", T.CONTRACTS[2], "Transfer", V.TRANSFER_TOPIC, "mystery_transfer"),
         ("mystery", T.CONTRACTS[2], "Other", OTHER_TOPIC, "mystery_other")],
        "contract string, address string, event string, topic0 string, table_name string")


@query("dec5_route", sql(["moves_raw"], """
SELECT block_number, log_index, CASE WHEN contract_no = 0 THEN 'usdc_transfer' WHEN block_number % 2 = 0 THEN 'mystery_other' ELSE 'mystery_transfer' END AS table_name,
  count(*) AS n FROM moves_raw WHERE contract_no = 2 OR (contract_no = 0 AND block_number % 2 = 1) GROUP BY ALL"""))
def dec5(spark, sf):
    """Even blocks log another topic, which one of the contracts does not have."""
    logs = T.raw_logs(spark, sf).withColumn("address", F.upper("address")).withColumn("address", F.regexp_replace("address", "^0X", "0x"))
    logs = logs.withColumn("topics", F.when(F.col("block_number") % 2 == 0, F.array(F.lit(OTHER_TOPIC))).otherwise(F.col("topics")))
    return D.route(logs, _routes(spark)).groupBy("block_number", "log_index", "table_name").agg(F.count("*").alias("n"))


@query("dec6_decode_logs", sql(["moves_raw"], """
SELECT block_number, log_index, tx_hash, from_addr AS "from", to_addr AS "to", CAST(value AS VARCHAR) AS value FROM moves_raw"""))
def dec6(spark, sf):
    x = D.decode_logs(T.raw_logs(spark, sf), TRANSFER_INPUTS)
    return x.select("block_number", "log_index", "tx_hash", "row.from", "row.to", F.col("row.value").cast("string").alias("value"))


@query("dec6_dynamic_params", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_size % 4 = 0 THEN '[]'
    ELSE '["' || array_to_string(list_transform(range(p_size % 4), lambda i: CAST(p_partkey + i AS VARCHAR)), '","') || '"]' END AS amounts,
  p_partkey % 9 = 0 AS lost FROM part""")
def dec6_dynamic(spark, sf):
    """A text and a list of amounts per log through the tail decoder; every ninth log is cut short."""
    def word(v):
        return F.lpad(F.lower(F.hex(v.cast("bigint"))), 64, "0")
    part = T.table(spark, sf, "part").select("p_partkey", "p_name", (F.col("p_size") % 4).alias("k"))
    text = F.lower(F.hex(F.col("p_name").cast("binary")))
    whole = (F.ceil(F.length(text) / 64) * 64).cast("int")
    body = F.when(F.col("k") == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.col("k") - 1, F.lit(0))), lambda i: word(F.col("p_partkey") + i)), ""))
    data = F.concat(F.lit("0x"), word(F.lit(64)), word(96 + whole / 2), word(F.length(text) / 2), F.rpad(text, whole, "0"), word(F.col("k")), body)
    data = F.when(F.col("p_partkey") % 9 == 0, F.substring(data, 1, 2 + 64 * 3)).otherwise(data)
    logs = part.select("p_partkey", F.array(F.lit("0xaa")).alias("topics"), data.alias("data"))
    x = D.decode_logs(logs, [("name", "string", False), ("amounts", "uint256[]", False)])
    return x.select(F.col("p_partkey").alias("id"), F.col("row.name").alias("name"), F.col("row.amounts").alias("amounts"), F.col("error").isNotNull().alias("lost"))


def _times_2_128(v: str) -> str:
    """v * 2^128 as digits, by long multiplication with limbs of eight digits (the product has no integer type here)."""
    digits = str(2**128)
    limbs = [digits[max(0, at - 8):at] for at in range(len(digits), 0, -8)]
    carry, out = "0::HUGEINT", []
    for limb in limbs:
        step = f"({v} * {int(limb)} + {carry})"
        out.append(f"lpad(CAST({step} % 100000000 AS VARCHAR), 8, '0')")
        carry = f"({step} // 100000000)"
    return f"ltrim(CAST({carry} AS VARCHAR) || {' || '.join(reversed(out))}, '0')"


@query("dec7_u256", sql(["moves_raw"], f"""
WITH s AS (SELECT contract_no, block_number % 2 = 0 AS wide, sum(CAST(value AS HUGEINT)) AS total, max(CAST(value AS HUGEINT)) AS top, count(*) AS n FROM moves_raw GROUP BY ALL)
SELECT contract_no, wide, CASE WHEN wide THEN {_times_2_128('total')} ELSE CAST(total AS VARCHAR) END AS total,
  lpad(CASE WHEN wide THEN {_times_2_128('top')} ELSE CAST(top AS VARCHAR) END, 78, '0') AS top, n FROM s"""))
def dec7(spark, sf):
    """Amounts of even blocks are moved up by 128 bits, beyond any 38 digits."""
    word = F.substring("data", 3, 64)
    wide = F.col("block_number") % 2 == 0
    x = T.raw_logs(spark, sf).select(
        "address", wide.alias("wide"), u256(F.when(wide, F.concat(F.substring(word, 33, 32), F.lit("0" * 32))).otherwise(word)).alias("v"))
    no = F.array_position(F.array(*[F.lit(c) for c in T.CONTRACTS]), F.col("address")) - 1
    return x.groupBy(no.cast("int").alias("contract_no"), "wide").agg(
        u256_sum(F.col("v")).alias("total"), F.max(u256_key(F.col("v"))).alias("top"), F.count("*").alias("n"))


@query("dec8_block_times", sql(["ev"], """
WITH b AS (SELECT block_number, min(t) AS bt FROM ev GROUP BY 1),
x AS (SELECT *, block_number // 50 AS batch, CASE WHEN event_id % 251 = 0 THEN NULL ELSE t END AS own FROM ev)
SELECT x.event_id, strftime(CASE WHEN bool_or(own IS NULL) OVER (PARTITION BY batch) THEN b.bt ELSE own END, '%Y-%m-%d %H:%M:%S') AS at
FROM x LEFT JOIN b USING (block_number)"""))
def dec8(spark, sf):
    ev = T.ev(spark, sf)
    logs = ev.withColumn("batch", F.floor(F.col("block_number") / 50)).withColumn(
        "block_timestamp", F.when(F.col("event_id") % 251 != 0, F.col("t")))
    blocks = ev.groupBy("block_number").agg(F.min("t").alias("block_time"))
    return D.resolve_block_times(logs, blocks, ["batch"]).select("event_id", F.date_format("block_time", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("dec10_drop_mirrors", sql(["moves"], """
WITH s AS (SELECT *, (CAST(value AS HUGEINT) + 999999999999) // 1000000000000 AS v6 FROM moves),
erc AS (SELECT tx_hash, from_addr, to_addr, v6 * 1000000000000 AS value FROM s WHERE log_index <= 4),
nat AS (SELECT tx_hash, from_addr, to_addr, log_index + 100 AS log_index, CASE WHEN log_index <= 4 THEN v6 * 1000000000000 ELSE CAST(value AS HUGEINT) END AS value FROM s
  UNION ALL SELECT tx_hash, from_addr, to_addr, log_index + 200, v6 * 1000000000000 FROM s WHERE log_index <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY tx_hash, from_addr, to_addr, value ORDER BY log_index) AS rn FROM nat),
c AS (SELECT tx_hash, from_addr, to_addr, value, count(*) AS n FROM erc GROUP BY ALL)
SELECT r.tx_hash, r.log_index, CAST(r.value AS VARCHAR) AS value FROM r LEFT JOIN c
  ON c.tx_hash = r.tx_hash AND c.from_addr = r.from_addr AND c.to_addr = r.to_addr AND c.value = r.value WHERE rn > coalesce(n, 0)"""))
def dec10(spark, sf):
    """Lines up to four are logged twice by the native address once, the first two once more; the rest only natively."""
    m = stored(T.moves(spark, sf).select("tx_hash", "from_addr", "to_addr", "log_index", "value"), "moves").withColumn("v6", E.native_to_6(F.col("value")))
    scaled = (F.col("v6") * F.lit(10**12).cast("decimal(13,0)")).cast(E.BIG)
    erc = m.filter("log_index <= 4").select("tx_hash", "from_addr", "to_addr", "log_index", F.col("v6").alias("value"))
    native = m.select("tx_hash", "from_addr", "to_addr", (F.col("log_index") + 100).alias("log_index"),
                      F.when(F.col("log_index") <= 4, scaled).otherwise(F.col("value")).alias("value"))
    again = m.filter("log_index <= 2").select("tx_hash", "from_addr", "to_addr", (F.col("log_index") + 200).alias("log_index"), scaled.alias("value"))
    return E.drop_mirrors(erc, native.unionByName(again)).select("tx_hash", "log_index", num("value"))


@query("dec11_native_scale", sql(["moves"], """
SELECT block_number, log_index, CAST((CAST(value AS HUGEINT) + 999999999999) // 1000000000000 AS VARCHAR) AS value FROM moves"""))
def dec11(spark, sf):
    return T.moves(spark, sf).select("block_number", "log_index", E.native_to_6(F.col("value")).cast("string").alias("value"))


@query("dec12_gas_refunds", sql(["moves", "ctx"], f"""
WITH m AS (SELECT block_number, log_index, tx_hash, CASE log_index WHEN 2 THEN '{V.ENTRYPOINTS[0]}' WHEN 3 THEN '{V.ENTRYPOINTS[2]}' ELSE from_addr END AS f,
  CASE log_index WHEN 2 THEN from_addr ELSE to_addr END AS t FROM moves)
SELECT m.block_number, m.log_index, m.f AS from_addr, m.t AS to_addr FROM m LEFT JOIN ctx c ON c.tx_hash = m.tx_hash
WHERE NOT coalesce(f IN ('{V.ENTRYPOINTS[0]}', '{V.ENTRYPOINTS[2]}') AND t = c.sender, false)"""))
def dec12(spark, sf):
    """Second logs are refunds to the sender, third ones come from an EntryPoint but go elsewhere."""
    li = F.col("log_index")
    m = T.moves(spark, sf).withColumn("_f", F.when(li == 2, V.ENTRYPOINTS[0]).when(li == 3, V.ENTRYPOINTS[2]).otherwise(F.col("from_addr")))
    m = m.withColumn("to_addr", F.when(li == 2, F.col("from_addr")).otherwise(F.col("to_addr"))).withColumn("from_addr", F.col("_f"))
    return E.drop_gas_refunds(m.select("block_number", "log_index", "tx_hash", "from_addr", "to_addr"), T.tx_ctx(spark, sf)).select(
        "block_number", "log_index", "from_addr", "to_addr")


@query("dec13_tx_context", sql(["ctx"], """
SELECT '0x' || sha256(CAST(o_orderkey AS VARCHAR)) AS tx_hash, c.ctx_to AS "to", c.selector, array_to_string(c.topics, ',') AS topics, c.sender,
  array_to_string(c.emitters, ',') AS emitters, c.value_sent FROM orders LEFT JOIN ctx c ON c.block_number = o_orderkey"""))
def dec13(spark, sf):
    x = E.tx_context(T.transactions(spark, sf), T.receipt_logs(spark, sf))
    return x.select("tx_hash", "ctx.to", "ctx.selector", F.array_join("ctx.topics", ",").alias("topics"), "ctx.sender",
                    F.array_join("ctx.emitters", ",").alias("emitters"), "ctx.value_sent")


@query("dec14_factories", sql(["ctx"], """
SELECT '0x' || sha256(CAST(o_orderkey AS VARCHAR)) AS tx_hash, CASE WHEN c.tx_hash IS NOT NULL THEN
  CASE WHEN c.factory IS NOT NULL THEN c.emitters[2] || '=' || c.factory ELSE '' END END AS factories
FROM orders LEFT JOIN ctx c ON c.block_number = o_orderkey"""))
def dec14(spark, sf):
    ctx = E.tx_context(T.transactions(spark, sf), T.receipt_logs(spark, sf))
    x = E.with_factories(ctx, T.pool_factories(spark, sf))
    pairs = F.transform(F.map_entries("ctx.factories"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return x.select("tx_hash", F.array_join(pairs, ",").alias("factories"))


@query("dec15_party_kinds", sql(["kinds"], "SELECT address, is_contract FROM kinds"))
def dec15(spark, sf):
    return E.party_kinds(T.moves(spark, sf), T.tx_ctx(spark, sf), T.codes(spark, sf))


@query("dec16_token_dim", r"""
WITH p AS (SELECT p_partkey AS k, '0x8' || lpad(CAST(p_partkey AS VARCHAR), 39, '0') AS address, p_name, p_brand FROM part),
r AS (SELECT *, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN p_name WHEN 2 THEN '  ' || upper(substr(p_name, 1, 3)) || ' ' ELSE replace(p_brand, '#', '.') END AS symbol,
  CASE WHEN k % 4 = 3 THEN NULL ELSE CAST(k % 4 * 6 AS INTEGER) END AS decimals FROM p)
SELECT address, CASE WHEN k % 50 = 7 THEN 'USDC' WHEN regexp_full_match(trim(symbol), '[A-Za-z0-9$._-]{1,16}') THEN trim(symbol) ELSE 'token' || CAST(k AS VARCHAR) END AS label,
  CASE WHEN k % 50 = 7 THEN 18 ELSE decimals END AS decimals, nullif(left(trim(symbol), 16), '') AS page_symbol FROM r""")
def dec16(spark, sf):
    part = T.table(spark, sf, "part").select(T.padded("0x8", F.col("p_partkey"), 39).alias("address"), "p_partkey")
    events = part.select("address", F.concat(F.lit("token"), F.col("p_partkey").cast("string")).alias("contract"))
    known = part.filter("p_partkey % 50 = 7").select("address", F.lit("USDC").alias("label"), F.lit(18).alias("decimals"))
    reads = T.token_reads(spark, sf)
    page = E.token_meta(reads).select("address", F.col("symbol").alias("page_symbol"))
    return E.token_dim(events, known, reads).join(page, "address", "left")


@query("dec17_address_ids", sql(["moves"], """
WITH s AS (SELECT from_addr AS address, block_number AS b, log_index AS l FROM moves UNION ALL SELECT to_addr, block_number, log_index FROM moves),
f AS (SELECT address, min((b, l)) AS first FROM s WHERE address NOT LIKE '0x5%7' GROUP BY 1),
known AS (SELECT '0x5' || lpad(CAST(s_suppkey AS VARCHAR), 39, '0') AS address, s_suppkey + 1 AS id FROM supplier WHERE s_suppkey % 10 = 7),
ids AS (SELECT address, (SELECT max(id) FROM known) + row_number() OVER (ORDER BY first, address) AS id FROM f UNION ALL SELECT address, id FROM known)
SELECT block_number, log_index, f.id AS from_id, t.id AS to_id FROM moves JOIN ids f ON f.address = from_addr JOIN ids t ON t.address = to_addr"""))
def dec17(spark, sf):
    """Every tenth supplier is already in the dictionary; the rest gets ids after the largest known one."""
    moves = T.moves(spark, sf)
    known = T.table(spark, sf, "supplier").filter("s_suppkey % 10 = 7").select(
        (F.col("s_suppkey") + 1).alias("id"), T.supplier_address(F.col("s_suppkey")).alias("address"))
    new = E.assign_ids(known, moves, ["from_addr", "to_addr"])
    return E.swap_ids(moves, {"from_addr": "from_id", "to_addr": "to_id"}, known.unionByName(new)).select(
        "block_number", "log_index", "from_id", "to_id")


@query("dec18_union_events", sql(["transfers", "swaps", "modifies", "donates", "inits"], """
SELECT 'transfer' AS table_name, block_number, tx_hash, log_index, from_addr, to_addr, CAST(value AS VARCHAR) AS value FROM transfers
UNION ALL SELECT 'swap', block_number, tx_hash, log_index, NULL, NULL, NULL FROM swaps
UNION ALL SELECT 'modify', block_number, tx_hash, log_index, NULL, NULL, NULL FROM modifies
UNION ALL SELECT 'donate', block_number, tx_hash, log_index, NULL, NULL, NULL FROM donates
UNION ALL SELECT 'initialize', block_number, tx_hash, log_index, NULL, NULL, NULL FROM inits"""))
def dec18(spark, sf):
    tables = [("transfer", T.transfers(spark, sf), True), ("swap", T.swaps(spark, sf), False), ("modify", T.modifies(spark, sf), False),
              ("donate", T.donates(spark, sf), False), ("initialize", T.inits(spark, sf).withColumn("contract_no", F.lit(0)), False)]
    return E.union_events(tables, 0, 1 << 40).select(
        "table_name", "block_number", "tx_hash", "log_index", "from_addr", "to_addr", num("value")).orderBy("block_number", "log_index")
