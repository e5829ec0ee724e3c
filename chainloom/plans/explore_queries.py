"""Registered queries: totals, histories, transactions, the live tape and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.amounts import parse_before
from ..operators import decode as D
from ..operators import enrich as E
from ..operators import explore as X
from ..session import new_folder, stored
from ..sources import testdata as T
from . import frames
from .archive_queries import archive_of, archive_rows, big, ingested, named_rows, num
from .facts_queries import _group_sql
from .oracle_views import short_sql, sql, texts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return add


_DAILY = """
SELECT address, strftime(block_time, '%Y-%m-%d') AS day, sum(i) AS in_value, sum(o) AS out_value, sum(ic) AS in_count, sum(oc) AS out_count FROM (
  SELECT to_addr AS address, block_time, CAST(value AS HUGEINT) AS i, CAST(0 AS HUGEINT) AS o, 1 AS ic, 0 AS oc FROM moves
  UNION ALL SELECT from_addr, block_time, 0, CAST(value AS HUGEINT), 0, 1 FROM moves) GROUP BY 1, 2"""
_DAILY_OUT = f"""
SELECT address, day, CAST(in_value AS VARCHAR) AS in_value, CAST(out_value AS VARCHAR) AS out_value,
  CAST(in_count AS BIGINT) AS in_count, CAST(out_count AS BIGINT) AS out_count FROM ({_DAILY})"""


def out_daily(df):
    return df.select("address", "day", num("in_value"), num("out_value"), "in_count", "out_count")


@query("q1_daily_rollup", sql(["moves"], _DAILY_OUT))
def q1(spark, sf):
    return out_daily(X.daily_rollup(T.moves(spark, sf)))


_LIMB = 10**26

def _limb_text(v: str) -> str:
    """Digits of the limbs v_hi, v_mid and v_lo after sums, carried."""
    b = f"CAST('{_LIMB}' AS HUGEINT)"
    lo, mid = f"({v}_lo % {b})", f"(({v}_mid + {v}_lo // {b}) % {b})"
    hi = f"({v}_hi + ({v}_mid + {v}_lo // {b}) // {b})"
    return f"coalesce(nullif(ltrim(CAST({hi} AS VARCHAR) || lpad(CAST({mid} AS VARCHAR), 26, '0') || lpad(CAST({lo} AS VARCHAR), 26, '0'), '0'), ''), '0')"


def _limb_sql(name: str, digit: int) -> str:
    """A limb of an amount: 2^256 - 1 in every tenth block."""
    top = (2**256 - 1) // _LIMB**digit % _LIMB
    own = {0: f"CAST(value AS HUGEINT) % CAST('{_LIMB}' AS HUGEINT)", 1: f"CAST(value AS HUGEINT) // CAST('{_LIMB}' AS HUGEINT)", 2: "CAST(0 AS HUGEINT)"}[digit]
    return f"CASE WHEN block_number % 10 = 5 THEN CAST('{top}' AS HUGEINT) ELSE {own} END AS {name}"


@query("q1_wide_rollup", sql(["moves_raw"], f"""
WITH r AS (SELECT from_addr, to_addr, block_time, {_limb_sql('v_hi', 2)}, {_limb_sql('v_mid', 1)}, {_limb_sql('v_lo', 0)}
  FROM moves_raw WHERE block_number % 10 NOT IN (1, 2, 3, 4)
  QUALIFY row_number() OVER (PARTITION BY block_number, log_index ORDER BY CASE WHEN block_number % 10 = 5 THEN 0 ELSE value END, to_addr) = 1),
s AS (SELECT to_addr AS address, block_time, v_hi AS i_hi, v_mid AS i_mid, v_lo AS i_lo, 0 AS o_hi, 0 AS o_mid, 0 AS o_lo, 1 AS ic, 0 AS oc FROM r
  UNION ALL SELECT from_addr, block_time, 0, 0, 0, v_hi, v_mid, v_lo, 0, 1 FROM r),
d AS (SELECT address, strftime(block_time, '%Y-%m-%d') AS day, {', '.join(f'CAST(sum({c}) AS HUGEINT) AS {c}' for c in ('i_hi', 'i_mid', 'i_lo', 'o_hi', 'o_mid', 'o_lo'))},
  CAST(sum(ic) AS BIGINT) AS in_count, CAST(sum(oc) AS BIGINT) AS out_count FROM s GROUP BY 1, 2)
SELECT address, day, {_limb_text('i')} AS in_value, {_limb_text('o')} AS out_value, in_count, out_count FROM d"""))
def q1_wide(spark, sf):
    """Amounts up to 2^256 - 1 from raw logs through the stream, the archive and daily totals folded in three ranges, then compacted."""
    archive = ingested(spark, sf)
    rows = stored(named_rows(archive), "rows")
    blocks = archive.read("blocks")
    head = archive.cursor().first()["last_block"]
    rollup, done = (X.Rollup(spark, new_folder(spark, "rollup"), limbs=True) for _ in range(2))
    for batch_id, span in enumerate((head // 5, head // 2, 2 * head)):
        lo, hi = rollup.next_range(blocks, -1, head, span)
        rollup.fold_range(rows, blocks, lo, hi, batch_id)
    rollup.compact(done, 0)
    return done.read().select("address", "day", big("in_value"), big("out_value"), "in_count", "out_count")


@query("q2_incremental_rollup", sql(["moves"], _DAILY_OUT))
def q2(spark, sf):
    """Uneven ranges folded one after another, two of them twice, then compacted."""
    moves = stored(T.moves(spark, sf).select("block_number", "log_index", "from_addr", "to_addr", "value", "block_time"), "moves")
    blocks = T.blocks(moves)
    rows = moves.drop("block_time")
    head = blocks.agg(F.max("block_number").alias("b")).first()["b"]
    rollup = X.Rollup(spark, new_folder(spark, "rollup"))
    for batch_id, span in enumerate((head // 7, head // 3, 2 * head)):
        lo, hi = rollup.next_range(blocks, -1, head, span)
        for _ in range(2 if batch_id < 2 else 1):
            rollup.fold_range(rows, blocks, lo, hi, batch_id)
    done = X.Rollup(spark, new_folder(spark, "rollup"))
    rollup.compact(done, 0)
    return out_daily(done.read())


@query("q3_address_totals", sql(["moves"], f"""
SELECT address, CAST(sum(in_value) AS VARCHAR) AS in_value, CAST(sum(out_value) AS VARCHAR) AS out_value, CAST(sum(in_count) AS BIGINT) AS in_count,
  CAST(sum(out_count) AS BIGINT) AS out_count, min(day) AS first_day, max(day) AS last_day FROM ({_DAILY}) GROUP BY 1"""))
def q3(spark, sf):
    t = X.address_totals(X.daily_rollup(T.moves(spark, sf)))
    return t.select("address", num("in_value"), num("out_value"), "in_count", "out_count", "first_day", "last_day")


@query("q4_day_series", sql(["moves"], """
WITH m AS (SELECT *, 'c' || CAST(contract_no AS VARCHAR) || CASE WHEN to_addr LIKE '0x5%' THEN 'pay' ELSE 'own' END AS k FROM moves WHERE block_number % 20 <> 0),
d AS (SELECT k AS address, strftime(block_time, '%Y-%m-%d') AS day, sum(CAST(value AS HUGEINT)) AS v FROM m GROUP BY ALL),
s AS (SELECT address, min(CAST(day AS DATE)) AS a, max(CAST(day AS DATE)) AS b, CAST(max(v) AS DOUBLE) AS top FROM d GROUP BY 1),
g AS (SELECT address, top, strftime(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM s)
SELECT g.address, g.day, CAST(coalesce(d.v, 0) AS VARCHAR) AS value, round(CASE WHEN d.v > 0 THEN greatest(1.0, sqrt(CAST(d.v AS DOUBLE) / top) * 82) ELSE 0.0 END, 6) AS h
FROM g LEFT JOIN d ON d.address = g.address AND d.day = g.day""".replace(" WHERE block_number % 20 <> 0", "")))
def q4(spark, sf):
    """A series per contract and kind of payee, so every day of every series is checked."""
    key = F.concat(F.lit("c"), F.col("contract_no").cast("string"), F.when(F.col("to_addr").startswith("0x5"), "pay").otherwise("own"))
    rows = T.moves(spark, sf).select(key.alias("to_addr"), F.lit("all").alias("from_addr"), "value", "block_time")
    daily = X.daily_rollup(rows).filter("address <> 'all'")
    s = X.day_series(daily)
    return s.select("address", "day", F.col("in_value").cast("string").alias("value"), F.round("in_h", 6).alias("h"))


_MOVEMENTS = """
SELECT from_addr AS address, to_addr AS counterparty, CASE WHEN from_addr = to_addr THEN 'self' ELSE 'out' END AS dir, block_number, log_index, tx_hash, value, block_time FROM moves
UNION ALL SELECT to_addr, from_addr, 'in', block_number, log_index, tx_hash, value, block_time FROM moves WHERE from_addr <> to_addr"""
_PAGE = f"SELECT *, row_number() OVER (PARTITION BY address ORDER BY block_number DESC, log_index DESC) AS rn FROM ({_MOVEMENTS})"


@query("q5_address_history", sql(["moves", "live_scored"], f"""
WITH p AS (SELECT *, count(*) OVER (PARTITION BY address) AS n FROM ({_PAGE} ) WHERE (block_number, log_index) < (12000, 3))
SELECT p.address, p.block_number, p.log_index, p.tx_hash, p.dir, p.counterparty, CAST(p.value AS VARCHAR) AS value, CAST(epoch(p.block_time) AS BIGINT) AS time, s.lane,
  CASE WHEN n > 25 AND r = 25 THEN CAST(p.block_number AS VARCHAR) || '-' || CAST(p.log_index AS VARCHAR) END AS older
FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY block_number DESC, log_index DESC) AS r FROM p) p
JOIN live_scored s ON s.block_number = p.block_number AND s.log_index = p.log_index WHERE r <= 25"""))
def q5(spark, sf):
    """Every address's page before one position."""
    page = X.address_history(T.moves(spark, sf), frames.live_scored(spark, sf, frames.PLACE), before=(12000, 3))
    return page.select("address", "block_number", "log_index", "tx_hash", "dir", "counterparty", num("value"), "time", "lane", "older")


@query("q5_address_page", sql(["moves"], f"""
WITH p AS (SELECT *, count(*) OVER () AS n FROM ({_PAGE}) WHERE address = (SELECT arg_max(from_addr, block_number) FROM moves))
SELECT address, block_number, log_index, tx_hash, dir, counterparty, CAST(value AS VARCHAR) AS value,
  CASE WHEN n > 25 AND rn = 25 THEN CAST(block_number AS VARCHAR) || '-' || CAST(log_index AS VARCHAR) END AS older FROM p WHERE rn <= 25"""))
def q5_page(spark, sf):
    """The page of one named address, the newest sender: its filter goes into the scan."""
    moves = stored(T.moves(spark, sf), "moves")
    who = moves.agg(F.max_by("from_addr", "block_number")).first()[0]
    page = X.address_history(moves, address=who)
    return page.select("address", "block_number", "log_index", "tx_hash", "dir", "counterparty", num("value"), "older")


@query("q5_indexed_pages", sql(["moves"], f"""
WITH w AS (SELECT arg_max(from_addr, block_number) AS who FROM moves UNION SELECT '{V.ZERO_ADDRESS}' UNION SELECT min(from_addr) FROM moves),
p AS (SELECT *, count(*) OVER (PARTITION BY address) AS n FROM ({_PAGE}) WHERE address IN (SELECT who FROM w))
SELECT address, block_number, log_index, tx_hash, dir, counterparty, CAST(value AS VARCHAR) AS value, CAST(epoch(block_time) AS BIGINT) AS time,
  CASE WHEN n > rn AND rn % 25 = 0 THEN CAST(block_number AS VARCHAR) || '-' || CAST(log_index AS VARCHAR) END AS older FROM p WHERE rn <= 75"""))
def q5_indexed(spark, sf):
    """Three pages each of the newest sender, the first address and the busiest one, each page by the token of the one before, read by index from a compacted archive."""
    moves = archive_rows(spark, sf)
    archive = archive_of(spark, moves, 4)
    newest, first = moves.agg(F.max_by("from_addr", "block_number"), F.min("from_addr")).first()
    out = None
    for who in sorted({newest, first, V.ZERO_ADDRESS}):
        before = None
        for _ in range(3):
            page = stored(X.address_page(archive, who, before), "page")
            out = page if out is None else out.unionByName(page)
            token = page.filter("older IS NOT NULL").select(parse_before(F.col("older")).alias("t")).first()
            if token is None:
                break
            before = tuple(token["t"])
    return out.select("address", "block_number", "log_index", "tx_hash", "dir", "counterparty", big("value"), "time", "older")


@query("q6_counterparties", sql(["moves"], f"""
WITH p AS (SELECT * FROM ({_PAGE}) WHERE rn <= 1000), t AS (SELECT address, count(*) AS total FROM p GROUP BY 1),
c AS (SELECT address, counterparty, count(*) AS n, sum(CAST(value AS HUGEINT)) AS v FROM p WHERE dir <> 'self' GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY n DESC, v DESC, counterparty) AS place FROM c QUALIFY place <= 6)
SELECT t.address, t.total, b.place, b.counterparty, b.n, CAST(b.v AS VARCHAR) AS value FROM t LEFT JOIN b ON b.address = t.address"""))
def q6(spark, sf):
    x = X.recent_counterparties(T.moves(spark, sf))
    return x.select("address", "total", F.col("rn").cast("bigint").alias("place"), "counterparty", "n", num("value"))


@query("q7_recent_lanes", sql(["moves", "live_scored"], f"""
SELECT p.address, s.lane, count(*) AS n FROM ({_PAGE}) p JOIN live_scored s ON s.block_number = p.block_number AND s.log_index = p.log_index
WHERE p.rn <= 1000 GROUP BY 1, 2"""))
def q7(spark, sf):
    return X.recent_lanes(T.moves(spark, sf), frames.live_scored(spark, sf, frames.PLACE))


_TX_ROWS = """
tx AS (SELECT tx_hash, block_number, log_index AS li, 'Transfer' AS kind, from_addr AS a, to_addr AS b, NULL AS pool, CAST(value AS HUGEINT) AS x, NULL::HUGEINT AS y, NULL::BIGINT AS fee FROM transfers
UNION ALL SELECT tx_hash, block_number, log_index, 'Swap', sender, NULL, pool, CAST(amount0 AS HUGEINT), CAST(amount1 AS HUGEINT), fee FROM swaps
UNION ALL SELECT tx_hash, block_number, log_index, 'Liquidity', sender, NULL, pool, CAST(liquidity_delta AS HUGEINT), NULL, NULL FROM modifies
UNION ALL SELECT tx_hash, block_number, log_index, 'Donate', sender, NULL, pool, CAST(amount0 AS HUGEINT), CAST(amount1 AS HUGEINT), NULL FROM donates
UNION ALL SELECT tx_hash, block_number, log_index, 'Initialize', NULL, NULL, pool, NULL, NULL, fee FROM inits)"""
_TX_VIEWS = ["transfers", "swaps", "modifies", "donates", "inits"]


def tx_tables(spark, sf):
    """(moves, the five event tables): the moves are written once, and four tables are slices of them."""
    m = stored(T.moves(spark, sf), "moves")
    return m, [T.transfers(spark, sf, m), T.swaps(spark, sf, m), T.modifies(spark, sf, m), T.donates(spark, sf, m), T.inits(spark, sf)]


def tx_rows(spark, sf):
    return X.tx_rows(*tx_tables(spark, sf)[1])


@query("q8_tx_detail", sql([*_TX_VIEWS, "blocks"], f"""
WITH {_TX_ROWS} SELECT tx.tx_hash, tx.block_number, tx.li, tx.kind, tx.a, tx.b, tx.pool, CAST(tx.x AS VARCHAR) AS x, CAST(tx.y AS VARCHAR) AS y, tx.fee,
  coalesce(CAST(epoch(bl.block_time) AS BIGINT), 0) AS time, i.currency0, i.currency1, i.fee AS pool_fee, i.tick_spacing, i.hooks
FROM tx LEFT JOIN blocks bl ON bl.block_number = tx.block_number LEFT JOIN inits i ON i.pool = tx.pool"""))
def q8(spark, sf):
    moves, tables = tx_tables(spark, sf)
    d = X.tx_detail(X.tx_rows(*tables), T.blocks(moves), tables[4])
    return d.select("tx_hash", "block_number", "li", "kind", "a", "b", "pool", num("x"), num("y"), "fee", "time", "currency0", "currency1", "pool_fee", "tick_spacing", "hooks")


@query("q8_tx_page", sql([*_TX_VIEWS, "blocks"], f"""
WITH {_TX_ROWS}, o AS (SELECT * FROM tx WHERE tx_hash = (SELECT arg_max(tx_hash, block_number) FROM transfers))
SELECT o.tx_hash, min(o.block_number) AS block, max(coalesce(CAST(epoch(bl.block_time) AS BIGINT), 0)) AS time, count(DISTINCT i.pool) AS n_pools,
  string_agg(concat_ws('|', CAST(o.li AS VARCHAR), o.kind, o.a, o.b, o.pool, CAST(o.x AS VARCHAR), CAST(o.y AS VARCHAR), CAST(o.fee AS VARCHAR)), ';' ORDER BY o.li) AS events
FROM o LEFT JOIN blocks bl ON bl.block_number = o.block_number LEFT JOIN inits i ON i.pool = o.pool GROUP BY 1"""))
def q8_page(spark, sf):
    """The newest transaction as one nested row, its events written out as text."""
    moves, tables = tx_tables(spark, sf)
    newest = tables[0].agg(F.max_by("tx_hash", "block_number")).first()[0]
    page = X.tx_page(X.tx_rows(*tables), T.blocks(moves), tables[4], newest)
    event = lambda e: F.concat_ws("|", *[e[c].cast("string") for c in ("li", "kind", "a", "b", "pool", "x", "y", "fee")])
    return page.select("tx_hash", "block", "time", F.size("pools").cast("bigint").alias("n_pools"),
                       F.array_join(F.transform("events", event), ";").alias("events"))


@query("q8_indexed_tx", sql(["moves"], """
SELECT m.tx_hash, m.block_number, m.log_index, m.from_addr, m.to_addr, CAST(m.value AS VARCHAR) AS value, CAST(epoch(min(m.block_time) OVER (PARTITION BY m.block_number)) AS BIGINT) AS time
FROM moves m WHERE m.tx_hash IN (SELECT arg_max(tx_hash, block_number) FROM moves UNION SELECT arg_min(tx_hash, block_number) FROM moves
  UNION SELECT arg_min(tx_hash, (-n, tx_hash)) FROM (SELECT tx_hash, count(*) AS n FROM moves GROUP BY 1))"""))
def q8_indexed(spark, sf):
    """The newest, the oldest and the longest transaction, each read by its hash from a compacted archive."""
    moves = archive_rows(spark, sf)
    archive = archive_of(spark, moves, 4)
    ends = moves.agg(F.max_by("tx_hash", "block_number"), F.min_by("tx_hash", "block_number")).first()
    longest = moves.groupBy("tx_hash").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tx_hash").first()["tx_hash"]
    out = None
    for tx in sorted({*ends, longest}):
        found = X.transaction_page(archive, tx)
        out = found if out is None else out.unionByName(found)
    return out.select("tx_hash", "block_number", "log_index", "from_addr", "to_addr", big("value"), "time")


@query("q9_tx_lane", sql([*_TX_VIEWS, "scored"], f"""
WITH {_TX_ROWS}, ins AS (SELECT * FROM scored WHERE block_number BETWEEN 500 AND 12000 AND (block_number + log_index) % 3 <> 0),
h AS (SELECT tx.tx_hash, arg_min(struct_pack(lane := i.lane, p := i.lane_p, s := i.sentence), (tx.kind <> 'Transfer', tx.li)) FILTER (WHERE i.lane IS NOT NULL) AS l,
  min(tx.block_number) AS block FROM tx LEFT JOIN ins i ON i.block_number = tx.block_number AND i.log_index = tx.li GROUP BY 1)
SELECT tx_hash, CASE WHEN l IS NOT NULL THEN 'read' WHEN block < (SELECT min(block_number) FROM ins) THEN 'before' WHEN block > 12000 THEN 'pending' ELSE 'none' END AS state,
  l.lane AS lane, round(floor(l.p * 100 + 0.5) / 100, 6) AS p, l.s AS sentence FROM h"""))
def q9(spark, sf):
    """Lanes exist for a middle stretch of blocks only, with holes in it."""
    ins = frames.scored(spark, sf, (500, 12000), frames.PLACE).filter("(block_number + log_index) % 3 <> 0")
    x = X.tx_lane(tx_rows(spark, sf), ins, F.lit(12000))
    return x.select("tx_hash", "state", "lane", F.round("p", 6).alias("p"), "sentence")


_CHAIN = """
ch AS (SELECT tx_hash, count(*) AS n, bool_and(prev IS NULL OR prev = from_addr) AS is_chain,
  arg_min(from_addr, log_index) || '>' || string_agg(to_addr, '>' ORDER BY log_index) AS path
FROM (SELECT *, lag(to_addr) OVER (PARTITION BY tx_hash ORDER BY log_index) AS prev FROM {}) GROUP BY 1)"""
_BACK = """(SELECT tx_hash, log_index, value, CASE WHEN log_index % 2 = 0 THEN to_addr ELSE from_addr END AS from_addr,
  CASE WHEN log_index % 2 = 0 THEN from_addr ELSE to_addr END AS to_addr FROM transfers)"""


def back_and_forth(transfers):
    """Every second leg turned round, so that real chains of several hops occur."""
    even = F.col("log_index") % 2 == 0
    return transfers.withColumn("_f", F.when(even, F.col("to_addr")).otherwise(F.col("from_addr"))).withColumn(
        "to_addr", F.when(even, F.col("from_addr")).otherwise(F.col("to_addr"))).withColumn("from_addr", F.col("_f")).drop("_f")


@query("q10_transfer_chain", sql(["transfers"], f"""
WITH {_CHAIN.format(_BACK)} SELECT tx_hash, n, is_chain, CASE WHEN is_chain AND n <= 6 THEN path END AS path FROM ch"""))
def q10(spark, sf):
    x = X.transfer_chains(back_and_forth(T.transfers(spark, sf)))
    return x.select("tx_hash", "n", "is_chain", F.when(F.col("path").isNotNull(), F.array_join("path", ">")).alias("path"))


_FACE = f"CASE {{}} WHEN '{V.ZERO_ADDRESS}' THEN 18 WHEN '{V.USDC}' THEN 6 END"


@query("q11_tx_kind", sql(_TX_VIEWS, f"""
WITH {_TX_ROWS.replace('FROM transfers', 'FROM back')}, {_CHAIN.format('back')},
p AS (SELECT tx_hash, arg_min(struct_pack(pool := pool, x := x, y := y), li) FILTER (WHERE kind = 'Swap') AS s,
  arg_min(struct_pack(a := a, b := b, x := x), li) FILTER (WHERE kind = 'Transfer') AS f, arg_max(struct_pack(a := a, b := b, x := x), li) FILTER (WHERE kind = 'Transfer') AS l,
  count(*) FILTER (WHERE kind = 'Transfer') AS nt, sum(x) FILTER (WHERE kind = 'Transfer') AS total,
  count(*) FILTER (WHERE kind = 'Initialize') AS ni, count(*) FILTER (WHERE kind = 'Liquidity') AS nm FROM tx GROUP BY 1),
u AS (SELECT p.*, ch.is_chain, {_FACE.format('i.currency0')} AS d0, {_FACE.format('i.currency1')} AS d1 FROM p LEFT JOIN inits i ON i.pool = p.s.pool LEFT JOIN ch ON ch.tx_hash = p.tx_hash),
w AS (SELECT *, CASE WHEN d0 IS NOT NULL THEN s.x WHEN d1 IS NOT NULL THEN s.y END AS delta, coalesce(d0, d1) AS dec FROM u),
k AS (SELECT *, CASE WHEN s IS NOT NULL THEN CASE WHEN delta < 0 THEN 'swap out' WHEN delta > 0 THEN 'swap in' ELSE 'swap' END
  WHEN nt = 0 THEN CASE WHEN ni > 0 THEN 'pool created' WHEN nm > 0 THEN 'liquidity' ELSE 'donate' END
  WHEN is_chain THEN CASE WHEN f.a = '{V.ZERO_ADDRESS}' THEN 'mint' WHEN l.b = '{V.ZERO_ADDRESS}' THEN 'burn' WHEN nt = 1 AND f.a = f.b THEN 'self' ELSE 'paid' END ELSE 'many' END AS kind FROM w),
o AS (SELECT tx_hash, kind, dec, CASE kind WHEN 'swap out' THEN abs(delta) WHEN 'swap in' THEN delta WHEN 'mint' THEN l.x WHEN 'burn' THEN f.x WHEN 'self' THEN f.x WHEN 'paid' THEN f.x WHEN 'many' THEN total END AS amount FROM k)
SELECT tx_hash, kind, CAST(amount AS VARCHAR) AS amount, CASE WHEN amount IS NOT NULL THEN CASE WHEN kind LIKE 'swap%' THEN dec ELSE 18 END END AS decimals FROM o""".replace(
    "WITH tx AS", f"WITH back AS (SELECT t.block_number, b.* FROM transfers t JOIN {_BACK} b ON b.tx_hash = t.tx_hash AND b.log_index = t.log_index), tx AS", 1).replace(
    "WITH \ntx AS", f"WITH back AS (SELECT t.block_number, b.* FROM transfers t JOIN {_BACK} b ON b.tx_hash = t.tx_hash AND b.log_index = t.log_index), tx AS", 1)))
def q11(spark, sf):
    _, tables = tx_tables(spark, sf)
    moved = back_and_forth(tables[0])
    x = X.tx_kind(X.tx_rows(moved, *tables[1:]), tables[4], X.transfer_chains(moved))
    return x.select("tx_hash", "kind", num("amount"), "decimals")


@query("q12_release_gate", """
WITH r AS (SELECT event_id, CASE WHEN user_id % 17 = 0 THEN NULL ELSE event_id END AS cursor, CASE WHEN user_id % 13 = 0 THEN NULL ELSE event_id + 20 - user_id * 2 END AS lane_cursor,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE event_id + 5 - user_id % 40 END AS held, user_id % 7 <> 0 AS lanes_on FROM events)
SELECT event_id, CASE WHEN cursor IS NULL THEN NULL WHEN NOT lanes_on THEN cursor ELSE greatest(least(coalesce(lane_cursor, -1), cursor), least(coalesce(held, -1), cursor)) END AS "to" FROM r""")
def q12(spark, sf):
    u = F.col("user_id")
    rows = T.table(spark, sf, "events").select(
        "event_id", F.when(u % 17 != 0, F.col("event_id")).alias("cursor"), F.when(u % 13 != 0, F.col("event_id") + 20 - u * 2).alias("lane_cursor"),
        F.when(u % 11 != 0, F.col("event_id") + 5 - u % 40).alias("held"), (u % 7 != 0).alias("lanes_on"))
    return X.release_to(rows).select("event_id", "to")


@query("q12_held_through", sql(["blocks"], """
WITH h AS (SELECT max(block_number) AS cursor, max(block_time) AS now FROM blocks),
g AS (SELECT cursor, (SELECT max(block_number) FROM blocks WHERE block_time <= now - INTERVAL 30 DAY) AS held, cursor // 2 AS lane_cursor FROM h)
SELECT cursor, held, greatest(least(lane_cursor, cursor), least(coalesce(held, -1), cursor)) AS "to" FROM g"""))
def q12_held(spark, sf):
    """The hold from the blocks' own times, thirty days of them, as blocks here are days apart; lanes are half-way."""
    blocks = stored(T.blocks(T.moves(spark, sf)).withColumn("_ingested_at", F.col("block_time")), "blocks")
    now = blocks.agg(F.max("block_time").alias("t")).scalar()
    held = X.held_through(blocks, now, 30 * 86_400_000)
    rows = blocks.agg(F.max("block_number").alias("cursor")).select(
        "cursor", held.alias("held"), F.floor(F.col("cursor") / 2).alias("lane_cursor"), F.lit(True).alias("lanes_on"))
    return X.release_to(rows).select("cursor", "held", "to")


def _exact(v: str) -> str:
    return (f"CAST({v} // 1000000000000000000 AS VARCHAR) || CASE WHEN {v} % 1000000000000000000 = 0 THEN '' ELSE '.' || "
            f"rtrim(lpad(CAST({v} % 1000000000000000000 AS VARCHAR), 18, '0'), '0') END")


def _name(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.KNOWN_NAMES.items()) + " ELSE '' END"


_MOVE = (f"CAST(m.log_index AS VARCHAR) || ' ' || m.tx_hash || ' ' || m.from_addr || ' ' || {_name('m.from_addr')} || ' ' || m.to_addr || ' ' || "
         f"{_name('m.to_addr')} || ' ' || {_exact('CAST(m.value AS HUGEINT)')} || ' ' || coalesce(s.lane, '-')")


def out_messages(df, *more):
    def move(m):
        none = F.lit("")
        return F.concat_ws(" ", m["li"].cast("string"), m["tx"], m["from"], F.coalesce(m["from_name"], none), m["to"], F.coalesce(m["to_name"], none),
                           m["value"], F.coalesce(m["lane"], F.lit("-")))
    return df.select("n", "t", F.array_join(F.transform("moves", move), "; ").alias("moves"), *more)


def lanes_with_holes(spark, sf):
    return frames.live_scored(spark, sf, frames.PLACE).filter("(block_number + log_index) % 5 <> 0")


_HOLES = "live_scored s ON s.block_number = m.block_number AND s.log_index = m.log_index AND (s.block_number + s.log_index) % 5 <> 0"


@query("q13_block_messages", sql(["moves", "live_scored"], f"""
WITH f AS (SELECT block_number FROM moves ORDER BY block_number LIMIT 20001),
e AS (SELECT CASE WHEN count(*) <= 20000 THEN 1099511627776 ELSE greatest(max(block_number) - 1, min(block_number)) END AS page_end FROM f)
SELECT m.block_number AS n, CAST(min(epoch(m.block_time)) AS BIGINT) AS t, string_agg({_MOVE}, '; ' ORDER BY m.log_index) AS moves,
  m.block_number > (SELECT page_end FROM e) AS later_page FROM moves m LEFT JOIN {_HOLES} GROUP BY 1"""))
def q13(spark, sf):
    """All blocks; ``later_page`` marks those behind the first page of 20,000 movements."""
    moves = T.moves(spark, sf)
    messages = X.block_messages(moves, lanes_with_holes(spark, sf), -1, 1 << 40)
    return out_messages(messages.withColumn("later_page", F.col("n") > X.page_end(moves, -1, 1 << 40, cap=20_000)), "later_page")


@query("q14_catch_up", """
WITH r AS (SELECT event_id, CASE WHEN user_id % 19 = 0 THEN NULL ELSE event_id - user_id % 3 END AS target, CASE WHEN user_id % 23 = 0 THEN NULL ELSE event_id + 900 - user_id * 31 % 1900 END AS released,
  CASE WHEN user_id % 19 = 0 THEN NULL ELSE event_id END AS cursor FROM events),
m AS (SELECT *, CASE WHEN released IS NULL THEN CASE WHEN target IS NULL OR target < 0 THEN 'nothing' ELSE 'latest' END WHEN target IS NULL THEN 'nothing'
  WHEN cursor < released - 600 THEN CASE WHEN target < 0 THEN 'nothing' ELSE 'restart' END WHEN target <= released THEN 'nothing' WHEN target - released > 600 THEN 'latest' ELSE 'next' END AS mode FROM r)
SELECT event_id, mode, CASE WHEN mode = 'next' THEN released WHEN mode <> 'nothing' THEN target - 150 END AS lo, CASE WHEN mode <> 'nothing' THEN target END AS hi FROM m""")
def q14(spark, sf):
    u, e = F.col("user_id"), F.col("event_id")
    rows = T.table(spark, sf, "events").select(
        "event_id", F.when(u % 19 != 0, e - u % 3).alias("target"), F.when(u % 23 != 0, e + 900 - u * 31 % 1900).alias("released"), F.when(u % 19 != 0, e).alias("cursor"))
    return X.catch_up(rows).select("event_id", "mode", "lo", "hi")


@query("q15_latest_moves", sql(["moves", "live_scored"], f"""
WITH c AS (SELECT * FROM moves ORDER BY block_number DESC, log_index DESC LIMIT 40)
SELECT m.block_number AS n, CAST(min(epoch(m.block_time)) AS BIGINT) AS t, string_agg({_MOVE}, '; ' ORDER BY m.log_index) AS moves FROM c m LEFT JOIN {_HOLES} GROUP BY 1"""))
def q15(spark, sf):
    return out_messages(X.latest_moves(T.moves(spark, sf), lanes_with_holes(spark, sf)))


_META = r"""
meta AS (SELECT '0x8' || lpad(CAST(p_partkey AS VARCHAR), 39, '0') AS address,
  nullif(left(trim(CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_name WHEN 2 THEN '  ' || upper(substr(p_name, 1, 3)) || ' ' ELSE replace(p_brand, '#', '.') END), 16), '') AS symbol,
  CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_partkey % 4 * 6 END AS decimals FROM part)"""


def _side_sql(i: str) -> str:
    a, d, v = f"currency{i}", f"dec{i}", f"CAST(abs(amount{i}) AS HUGEINT)"
    p = f"CAST(pow(10, coalesce({d}, 0)) AS HUGEINT)"
    cents = f"(({v} * 200 + {p}) // (2 * {p}))"
    amount = (f"CASE WHEN {d} IS NULL THEN {_group_sql(f'CAST({v} AS VARCHAR)')} WHEN {cents} = 0 THEN '<0.01' ELSE "
              f"{_group_sql(f'CAST({cents} // 100 AS VARCHAR)')} || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0') END")
    token = f"coalesce(sym{i}, {short_sql(a)})"
    note = f"coalesce(sym{i}, 'token ' || {token}) || CASE WHEN {d} IS NULL THEN ' · decimals unknown' ELSE '' END"
    return f"({amount}) || '|' || {token} || '|' || {note}"


@query("q16_swap_sides", sql(["swaps", "inits"], f"""
WITH {_META}, x AS (SELECT s.tx_hash, s.log_index, s.amount0, s.amount1, s.fee, i.currency0, i.currency1, i.pool IS NOT NULL AS known,
  {_FACE.format('i.currency0')} AS dec0, CASE i.currency0 WHEN '{V.ZERO_ADDRESS}' THEN 'USDC (native)' WHEN '{V.USDC}' THEN 'USDC' END AS sym0, m.decimals AS dec1, m.symbol AS sym1
  FROM swaps s LEFT JOIN inits i ON i.pool = s.pool LEFT JOIN meta m ON m.address = i.currency1)
SELECT tx_hash, log_index, known, printf('%.2f', fee::DOUBLE / 10000.0::DOUBLE) || '%' AS fee,
  CASE WHEN NOT known THEN NULL WHEN amount0 < 0 THEN {_side_sql('0')} WHEN amount1 < 0 THEN {_side_sql('1')} END AS paid,
  CASE WHEN NOT known THEN NULL WHEN amount0 > 0 THEN {_side_sql('0')} WHEN amount1 > 0 THEN {_side_sql('1')} END AS received FROM x"""))
def q16(spark, sf):
    x = X.swap_sides(T.swaps(spark, sf), T.inits(spark, sf), E.token_meta(T.token_reads(spark, sf)))
    def text(c):
        return F.when(F.col(c).isNotNull(), F.concat_ws("|", f"{c}.amount", f"{c}.token", f"{c}.note")).alias(c)
    return x.select("tx_hash", "log_index", "known", "fee", text("paid"), text("received"))


def _wide_amount(v: int, dec: int | None) -> str:
    """An amount of 77 digits as the page shows it."""
    if dec is None:
        return f"{v:,}"
    cents = (v * 200 + 10**dec) // (2 * 10**dec)
    return f"{cents // 100:,}.{cents % 100:02d}"


def _wide_side_sql(i: str) -> str:
    """``_side_sql``, with the least and the largest int256 as the first amount of some blocks."""
    if i == "1":
        return _side_sql("1")
    top = "CASE block_number % 4 WHEN 1 THEN CASE dec0 {} END WHEN 2 THEN CASE dec0 {} END END".format(
        *[" ".join(f"WHEN {d} THEN '{_wide_amount(v, d)}'" for d in (6, 18)) + f" ELSE '{_wide_amount(v, None)}'" for v in (2**255, 2**255 - 1)])
    plain = _side_sql("0")
    token = f"coalesce(sym0, {short_sql('currency0')})"
    note = f"coalesce(sym0, 'token ' || {token}) || CASE WHEN dec0 IS NULL THEN ' · decimals unknown' ELSE '' END"
    return f"CASE WHEN block_number % 4 IN (1, 2) THEN ({top}) || '|' || {token} || '|' || {note} ELSE {plain} END"


@query("q16_wide_sides", sql(["swaps", "inits"], f"""
WITH {_META}, x AS (SELECT s.block_number, s.tx_hash, s.log_index, s.amount0, s.amount1, s.fee, i.currency0, i.currency1, i.pool IS NOT NULL AS known,
  CASE s.block_number % 4 WHEN 1 THEN -1 WHEN 2 THEN 1 ELSE sign(s.amount0) END AS way,
  {_FACE.format('i.currency0')} AS dec0, CASE i.currency0 WHEN '{V.ZERO_ADDRESS}' THEN 'USDC (native)' WHEN '{V.USDC}' THEN 'USDC' END AS sym0, m.decimals AS dec1, m.symbol AS sym1
  FROM swaps s LEFT JOIN inits i ON i.pool = s.pool LEFT JOIN meta m ON m.address = i.currency1)
SELECT tx_hash, log_index, known, printf('%.2f', fee::DOUBLE / 10000.0::DOUBLE) || '%' AS fee,
  CASE WHEN NOT known THEN NULL WHEN way < 0 THEN {_wide_side_sql('0')} WHEN amount1 < 0 THEN {_side_sql('1')} END AS paid,
  CASE WHEN NOT known THEN NULL WHEN way > 0 THEN {_wide_side_sql('0')} WHEN amount1 > 0 THEN {_side_sql('1')} END AS received FROM x"""))
def q16_wide(spark, sf):
    """Swap logs decoded from their int256 words, -2^255 and 2^255 - 1 among them."""
    s, edge = T.swaps(spark, sf), F.col("block_number") % 4
    word = F.when(edge == 1, "8" + "0" * 63).when(edge == 2, "7" + "f" * 63).otherwise(T.int_word(F.col("amount0")))
    logs = s.withColumn("data", F.concat(F.lit("0x"), word, T.int_word(F.col("amount1")))).withColumn("topics", F.array(F.lit("0x")))
    read = D.decode_logs(logs.drop("amount0", "amount1"), [("amount0", "int256", False), ("amount1", "int256", False)], limbs=True)
    read = stored(read.select("block_number", "log_index", "tx_hash", "pool", "fee", "row.*"), "decoded")  # as ``split_decoded`` does: no word is read twice
    x = X.swap_sides(read, T.inits(spark, sf), E.token_meta(T.token_reads(spark, sf)))
    def text(c):
        return F.when(F.col(c).isNotNull(), F.concat_ws("|", f"{c}.amount", f"{c}.token", f"{c}.note")).alias(c)
    return x.select("tx_hash", "log_index", "known", "fee", text("paid"), text("received"))


_SHORT_POOL = "left(pool, 10) || '…' || right(pool, 6)"
_CENTS = "((x + 5000000000000000) // 10000000000000000)"


@query("q17_tx_events", sql(_TX_VIEWS, f"""
WITH {_TX_ROWS} SELECT tx_hash, li, kind, CASE kind WHEN 'Transfer' THEN a || ' → ' || b WHEN 'Swap' THEN 'pool ' || {_SHORT_POOL} || ' · sender ' || a
  WHEN 'Liquidity' THEN 'pool ' || {_SHORT_POOL} || CASE WHEN x < 0 THEN ' · removed by ' ELSE ' · added by ' END || a
  WHEN 'Donate' THEN 'pool ' || {_SHORT_POOL} || ' · from ' || a ELSE 'pool ' || {_SHORT_POOL} || ' created · fee ' || printf('%.2f', fee::DOUBLE / 10000.0::DOUBLE) || '%' END AS parties,
  CASE WHEN kind = 'Transfer' THEN CASE WHEN x = 0 THEN '0.00' WHEN {_CENTS} = 0 THEN '<0.01' ELSE
    {_group_sql(f"CAST({_CENTS} // 100 AS VARCHAR)")} || '.' || lpad(CAST({_CENTS} % 100 AS VARCHAR), 2, '0') END || ' USDC' END AS amount FROM tx"""))
def q17(spark, sf):
    return X.tx_events(tx_rows(spark, sf)).orderBy("tx_hash", "li")


_ORDER = "list_position(" + texts(V.LANE_ORDER) + ", lane)"


@query("q18_top_lane", sql(["moves", "live_scored"], f"""
WITH c AS (SELECT p.address, s.lane, count(*) AS n FROM ({_PAGE}) p JOIN live_scored s ON s.block_number = p.block_number AND s.log_index = p.log_index WHERE p.rn <= 1000 GROUP BY 1, 2)
SELECT address, arg_min(lane, (-n, {_ORDER})) AS lane FROM c WHERE lane <> 'uncertain' GROUP BY 1"""))
def q18(spark, sf):
    return X.top_lane(X.recent_lanes(T.moves(spark, sf), frames.live_scored(spark, sf, frames.PLACE)))


@query("q19_lane_shares", sql(["ev"], f"""
WITH d AS (SELECT strftime(t, '%Y-%m-%d') AS day, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 101 = 1 THEN 'uncertain' ELSE lane END AS lane FROM ev),
p AS (SELECT day, count(*) AS total, count(lane) AS laned FROM d GROUP BY 1), c AS (SELECT day, lane, count(*) AS n FROM d GROUP BY 1, 2),
g AS (SELECT p.*, unnest({texts(V.LANE_ORDER)}) AS lane FROM p)
SELECT g.day, g.lane, CAST(floor((200 * coalesce(c.n, 0) + g.total) / (2.0 * g.total)) AS BIGINT) AS pct, g.laned * 2 < g.total AS paused
FROM g LEFT JOIN c ON c.day = g.day AND c.lane = g.lane WHERE coalesce(c.n, 0) > 0 OR list_contains({texts(V.LANES_ALWAYS)}, g.lane)"""))
def q19(spark, sf):
    e = F.col("event_id")
    rows = T.ev(spark, sf).select(F.date_format("t", "yyyy-MM-dd").alias("day"), F.when(e % 3 == 0, None).when(e % 101 == 1, "uncertain").otherwise(F.col("lane")).alias("lane"))
    return X.lane_shares(rows, ["day"])


@query("q20_rollup_state", sql(["moves"], """
WITH h AS (SELECT max(block_number) AS head FROM moves), k AS (SELECT from_addr AS address FROM moves UNION SELECT to_addr FROM moves),
m AS (SELECT * FROM moves, h WHERE block_number <= head // 200),
t AS (SELECT address, sum(v) AS net FROM (SELECT to_addr AS address, CAST(value AS HUGEINT) AS v FROM m UNION ALL SELECT from_addr, -CAST(value AS HUGEINT) FROM m) GROUP BY 1)
SELECT k.address, CAST(t.net AS VARCHAR) AS net, head // 200 < head - 120 AS behind,
  CASE WHEN t.address IS NULL THEN 'Totals are still being added (up to block ' || format('{:,}', head // 200) || ').' END AS empty_text
FROM k CROSS JOIN h LEFT JOIN t ON t.address = k.address"""))
def q20(spark, sf):
    moves = T.moves(spark, sf)
    head = moves.agg(F.max("block_number")).scalar()
    rolled = F.floor(head / 200)
    known = moves.select(F.explode(F.array("from_addr", "to_addr")).alias("address")).distinct()
    totals = X.address_totals(X.daily_rollup(moves.filter(F.col("block_number") <= rolled)))
    x = X.rollup_state(known, totals, rolled, head, "2026-05-15")
    return x.select("address", num("net"), "behind", "empty_text")


@query("q21_archive_status", """
WITH r AS (SELECT o_custkey, max(o_orderkey) AS head, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS current, count(*) % 4 = 0 AS failed, count(*) % 5 <> 0 AS open,
  CAST(max(epoch(o_orderdate)) AS BIGINT) AS newest FROM orders GROUP BY 1),
s AS (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN 'Live' ELSE 'Backfilling' END AS previous, greatest(0, head - current) AS lag, o_custkey * o_custkey % 400000 AS age FROM r)
SELECT o_custkey, lag, CASE WHEN failed THEN 'Degraded' WHEN current IS NULL THEN 'Provisioning' WHEN lag = 0 OR (previous = 'Live' AND lag <= 1000) THEN 'Live' ELSE 'Backfilling' END AS phase,
  CASE WHEN NOT open THEN 'down' WHEN age <= 15 THEN 'live' WHEN age < 120 THEN format('{:,}', age) || ' s behind'
    WHEN age < 7200 THEN format('{:,}', CAST(floor(age / 60 + 0.5) AS BIGINT)) || ' min behind' WHEN age < 172800 THEN format('{:,}', CAST(floor(age / 3600 + 0.5) AS BIGINT)) || ' h behind'
    ELSE format('{:,}', CAST(floor(age / 86400 + 0.5) AS BIGINT)) || ' days behind' END AS state FROM s""")
def q21(spark, sf):
    """One archive per customer, its clock some seconds after its newest block."""
    od = T.table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    rows = od.groupBy("o_custkey").agg(
        F.max("o_orderkey").alias("head"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("current"),
        (F.count("*") % 4 == 0).alias("failed"), (F.count("*") % 5 != 0).alias("open"), F.max(F.unix_timestamp("o_orderdate")).alias("newest_time"))
    k = F.col("o_custkey")
    rows = rows.withColumn("now", F.col("newest_time") + k * k % 400000).withColumn("previous", F.when(k % 2 == 0, "Live").otherwise("Backfilling"))
    return X.archive_status(rows).select("o_custkey", "lag", "phase", "state")


@query("q22_first_lane_block", sql(["scored", "blocks"], """
SELECT block_number, CAST(epoch(block_time) AS BIGINT) AS time FROM blocks WHERE block_number = (SELECT min(block_number) FROM scored WHERE ruled = '')"""))
def q22(spark, sf):
    return X.first_lane_block(frames.scored(spark, sf, columns=frames.PLACE).filter("ruled = ''"), T.blocks(T.moves(spark, sf)))


@query("q23_resume_after", sql(["moves", "live_scored"], f"""
WITH e AS (SELECT max(block_number) AS newest FROM moves), c AS (SELECT m.* FROM moves m, e WHERE block_number > newest - 100)
SELECT m.block_number AS n, CAST(min(epoch(m.block_time)) AS BIGINT) AS t, string_agg({_MOVE}, '; ' ORDER BY m.log_index) AS moves FROM c m LEFT JOIN {_HOLES} GROUP BY 1"""))
def q23(spark, sf):
    """The buffer holds every block; a viewer last saw the one a hundred before the newest."""
    moves = T.moves(spark, sf)
    newest = moves.agg(F.max("block_number").alias("b")).first()["b"]
    lanes = stored(lanes_with_holes(spark, sf).select("block_number", "log_index", "lane"), "lanes")
    messages = X.block_messages(moves, lanes, newest - 5000, newest)
    return out_messages(X.resume_after(messages, X.latest_moves(moves, lanes), newest - 100, F.lit(newest - 4000)))
