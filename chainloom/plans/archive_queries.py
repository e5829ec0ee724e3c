"""Registered queries: sources, sinks and the archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.wide import wide_text
from ..operators import decode as D
from ..operators.enrich import assign_ids, looked_up, swap_ids
from ..operators.ranking import global_rank
from ..session import CODEC, cleaning, new_folder, stored
from ..sources import archive as A
from ..sources import logs as L
from ..sources import testdata as T
from ..streaming.ingest import ingest
from .oracle_views import sql

TRANSFER_INPUTS = [("from", "address", True), ("to", "address", True), ("value", "uint256", False)]
num = lambda c: F.col(c).cast("string").alias(c)
big = lambda c: wide_text(F.col(c)).alias(c)
ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return add


@query("src1_read_logs", sql(["moves_raw"], f"""
WITH h AS (SELECT max(o_orderkey) AS head FROM orders)
SELECT CASE contract_no WHEN 0 THEN '{T.CONTRACTS[0]}' ELSE '{T.CONTRACTS[2]}' END AS address, block_number, tx_hash, log_index,
  CAST(value AS VARCHAR) AS amount, 3 AS n_topics
FROM moves_raw, h WHERE contract_no IN (0, 2) AND block_number BETWEEN head // 10 AND head - head // 10"""))
def src1(spark, sf):
    """Two of three contracts, without the first and last tenth of the chain, from a table in block parts."""
    path = A.write_event_table(T.raw_logs(spark, sf), new_folder(spark, "logs"), "raw", A.MIN_SIZE)
    head = T.table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]
    addresses = [T.CONTRACTS[0].upper().replace("0X", "0x"), T.CONTRACTS[2]]
    logs = L.read_logs(spark.read.parquet(path), addresses, head // 10, head - head // 10, A.MIN_SIZE)
    decoded = D.decode_logs(logs, TRANSFER_INPUTS)
    return decoded.select("address", "block_number", "tx_hash", "log_index",
                          F.col("row.value").cast("string").alias("amount"), F.size("topics").alias("n_topics"))


@query("src2_stream_logs", sql([], """
SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, value FROM events"""))
def src2(spark, sf):
    from ..streaming.jobs import drain
    schema = T.table(spark, sf, "events").schema
    stream = L.stream_logs(spark, f"{sf}/events.parquet", schema)
    return drain(spark, stream, "tail").select("event_id", "user_id", "event_type",
                                               F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "value")


PROGRESS = """event_id AS id, CASE WHEN user_id % 11 = 0 THEN NULL ELSE event_id - (user_id * 13) % 900 END AS cursor, event_id AS head"""


@query("src3_bounded_range", sql([], f"""
WITH p AS (SELECT {PROGRESS} FROM events), q AS (SELECT id, greatest(head - 2, 0) AS seen, cursor FROM p),
r AS (SELECT id, seen, coalesce(cursor, seen) AS c FROM q)
SELECT id, CASE WHEN seen < c THEN NULL WHEN seen - c + 1 > 600 THEN seen ELSE c END AS lo,
  CASE WHEN seen < c THEN NULL WHEN seen - c + 1 > 600 THEN seen ELSE least(seen, c + 199) END AS hi,
  CASE WHEN seen >= c AND seen - c + 1 > 600 THEN seen - c ELSE 0 END AS skipped,
  CASE WHEN seen > c AND seen - c + 1 > 600 THEN c END AS skipped_lo, CASE WHEN seen > c AND seen - c + 1 > 600 THEN seen - 1 END AS skipped_hi FROM r"""))
def src3(spark, sf):
    progress = T.table(spark, sf, "events").selectExpr(*[p.strip() for p in (
        "event_id AS id", "CASE WHEN user_id % 11 = 0 THEN NULL ELSE event_id - (user_id * 13) % 900 END AS cursor", "event_id AS head")])
    return L.bounded_range(progress).select("id", "lo", "hi", "skipped", "skipped_lo", "skipped_hi")


def _starts(spark, sf):
    """Start blocks as configured: absolute, behind the head, and absent (the head itself)."""
    head = T.table(spark, sf, "orders").agg(F.max("o_orderkey")).scalar()
    rows = [(T.CONTRACTS[0].upper(), 100), (T.CONTRACTS[1], -5000), (T.CONTRACTS[2], None)]
    return spark.createDataFrame(rows, "address string, start_block bigint"), head


@query("src4_apply_start", sql(["moves_raw"], """
WITH h AS (SELECT max(o_orderkey) AS head FROM orders)
SELECT block_number, log_index, contract_no, count(*) AS n FROM moves_raw
WHERE block_number >= CASE contract_no WHEN 0 THEN 100 WHEN 1 THEN (SELECT greatest(0, head - 5000) FROM h) ELSE (SELECT head FROM h) END
GROUP BY ALL"""))
def src4(spark, sf):
    contracts, head = _starts(spark, sf)
    logs = T.moves_raw(spark, sf).withColumn("address", T.contract_address(F.col("contract_no")))
    return L.apply_start(logs, contracts, head).groupBy("block_number", "log_index", "contract_no").agg(F.count("*").alias("n"))


@query("src5_plan_ranges", sql([], """
WITH s AS (SELECT min(o_orderkey) - 1 AS c, max(o_orderkey) AS h, o_orderstatus AS contract FROM orders GROUP BY o_orderstatus)
SELECT contract, lo, least(lo + 136, h) AS hi FROM (SELECT contract, h, unnest(range(c + 1, h + 1, 137)) AS lo FROM s)"""))
def src5(spark, sf):
    span = T.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("contract")).agg(
        (F.min("o_orderkey") - 1).alias("cursor"), F.max("o_orderkey").alias("head"))
    return L.plan_ranges(span, 137).select("contract", "lo", "hi")


@query("src6_clamp_to_head", sql(["moves_raw"], """
WITH h AS (SELECT max(o_orderkey) AS announced, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') - 7 AS answered FROM orders)
SELECT block_number, log_index, count(*) AS n, least(any_value(announced), any_value(answered)) AS new_cursor
FROM moves_raw, h WHERE block_number <= least(announced, answered) GROUP BY 1, 2"""))
def src6(spark, sf):
    od = T.table(spark, sf, "orders")
    announced = od.agg(F.max("o_orderkey")).scalar()
    answered = od.agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))) - 7).scalar()
    return L.clamp_to_head(T.moves_raw(spark, sf), announced, answered).groupBy("block_number", "log_index", "new_cursor").agg(
        F.count("*").alias("n"))


@query("snk1_event_table", sql(["moves"], """
SELECT block_number, log_index, tx_hash, CAST(value AS VARCHAR) AS value, CAST(block_number // 10000 AS INTEGER) AS block_part FROM moves"""))
def snk1(spark, sf):
    path = A.write_event_table(T.moves(spark, sf), new_folder(spark, "events"), "transfer", 10_000)
    return spark.read.parquet(path).select("block_number", "log_index", "tx_hash", num("value"), "block_part")


@query("snk2_append_new", sql(["moves_raw"], """
WITH known AS (SELECT DISTINCT block_number, log_index FROM moves_raw WHERE l_returnflag = 'A'),
fresh AS (SELECT * FROM moves_raw QUALIFY row_number() OVER (PARTITION BY block_number, log_index
  ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag) = 1)
SELECT block_number, log_index, CAST(value AS VARCHAR) AS value, to_addr FROM fresh
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.block_number = fresh.block_number AND k.log_index = fresh.log_index)"""))
def snk2(spark, sf):
    batch = stored(A.with_block_part(T.moves_raw(spark, sf), 10_000), "batch")
    known = batch.filter("l_returnflag = 'A'").select("block_number", "log_index", "block_part").distinct()
    return A.append_new(known, batch, ["block_number", "log_index"], T.FIRST_ORDER).select(
        "block_number", "log_index", num("value"), "to_addr")


@query("snk3_commit_batch", sql(["moves"], """
WITH a AS (SELECT a, row_number() OVER (ORDER BY batch, b, l, a) AS id FROM (
  SELECT a, min(batch) AS batch, arg_min(block_number, (batch, block_number, log_index)) AS b,
    arg_min(log_index, (batch, block_number, log_index)) AS l
  FROM (SELECT from_addr AS a, block_number, log_index, CASE WHEN log_index <= 3 THEN 0 ELSE 1 END AS batch FROM moves
        UNION ALL SELECT to_addr, block_number, log_index, CASE WHEN log_index <= 3 THEN 0 ELSE 1 END FROM moves) GROUP BY a))
SELECT m.block_number, m.log_index, f.id AS from_id, t.id AS to_id, CAST(m.value AS VARCHAR) AS value
FROM moves m JOIN a f ON f.a = m.from_addr JOIN a t ON t.a = m.to_addr"""))
def snk3(spark, sf):
    """Two batches, both replayed; the second also repeats the first one's rows."""
    rows = archive_rows(spark, sf)  # read by all four commits
    head = rows.agg(F.max("block_number").alias("b")).first()["b"]
    archive = A.Archive(spark, new_folder(spark, "archive"), A.MIN_SIZE)
    none = spark.createDataFrame([], A.Archive.DEAD)
    first = rows.filter("log_index <= 3")
    for batch_id, part in ((0, first), (0, first), (1, rows), (1, rows)):
        archive.commit_batch(part, none, head, batch_id, ["value"])
    return archive.read("rows").select("block_number", "log_index", "from_id", "to_id", big("value"))


_IDS_BY_PLACE = """
a AS (SELECT a, row_number() OVER (ORDER BY p, a) AS id FROM (
  SELECT a, min(p) AS p FROM (SELECT from_addr AS a, (block_number, log_index) AS p FROM moves UNION ALL SELECT to_addr, (block_number, log_index) FROM moves) GROUP BY a))"""


def archive_rows(spark, sf):
    """The moves with what an archive keeps of them, written once: all commits read them."""
    return stored(T.moves(spark, sf).select("block_number", "log_index", "tx_hash", "from_addr", "to_addr", "value", "block_time",
                                            T.hash_text(F.col("block_number")).alias("block_hash")), "moves")


def archive_of(spark, rows, batches: int, fan: int = 3):
    """All rows committed in ``batches`` stretches of blocks, compacted after each, every second one sent twice."""
    archive = A.Archive(spark, new_folder(spark, "archive"), A.MIN_SIZE, fan=fan)
    head = rows.agg(F.max("block_number")).first()[0]
    none, step = spark.createDataFrame([], A.Archive.DEAD), head // batches + 1
    for i in range(batches):
        part = rows.filter(F.col("block_number").between(i * step, (i + 1) * step - 1))
        for _ in range(1 + i % 2):
            archive.commit_batch(part, none, min(head, (i + 1) * step - 1), i, ["value"])
        archive.compact()
        archive.log.vacuum(archive.log.version)  # nobody reads yet
    return archive


@query("snk3_compaction", sql(["moves"], f"""
WITH {_IDS_BY_PLACE}
SELECT m.block_number, m.log_index, m.tx_hash, f.id AS from_id, m.from_addr, t.id AS to_id, m.to_addr, CAST(m.value AS VARCHAR) AS value,
  strftime(min(m.block_time) OVER (PARTITION BY m.block_number), '%Y-%m-%d %H:%M:%S') AS block_time
FROM moves m JOIN a f ON f.a = m.from_addr JOIN a t ON t.a = m.to_addr"""))
def snk3_compaction(spark, sf):
    """Six batches whose files are merged as they come in; rows, dictionary and blocks read back together."""
    rows = archive_rows(spark, sf)
    archive = archive_of(spark, rows, 6)
    return named_rows(archive).join(archive.read("blocks").select("block_number", "block_time"), "block_number", "left").select(
        "block_number", "log_index", "tx_hash", "from_id", "from_addr", "to_id", "to_addr", big("value"), ts("block_time"))


@query("snk4_build_blocks", sql(["moves"], """
SELECT block_number, '0x' || sha256('block' || CAST(block_number AS VARCHAR)) AS block_hash,
  strftime(min(block_time), '%Y-%m-%d %H:%M:%S') AS block_time FROM moves GROUP BY block_number"""))
def snk4(spark, sf):
    logs = T.raw_logs(spark, sf).withColumnRenamed("block_timestamp", "block_time")
    return A.build_blocks(logs).select("block_number", "block_hash", ts("block_time"))


def malformed(spark, sf, lines=None):
    """Raw logs, some with cut data, a missing topic, a topic that is no hash, or an amount of 78 digits."""
    logs = T.raw_logs(spark, sf, lines)
    key = F.col("block_number") % 10
    return logs.withColumn("data", F.when(key == 1, F.substring("data", 1, 40)).when(key == 2, F.lit("0x")).when(key == 5, F.lit("0x" + "f" * 64)).otherwise(F.col("data"))).withColumn(
        "topics", F.when(key == 3, F.slice("topics", 1, 2)).when(key == 4, F.array(F.get("topics", F.lit(0)), F.lit("0xzz"), F.get("topics", F.lit(2))))
        .otherwise(F.col("topics")))


_VALUE = f"CASE WHEN block_number % 10 = 5 THEN '{2**256 - 1}' ELSE CAST(value AS VARCHAR) END"


@query("snk5_dead_letters", sql(["moves_raw"], f"""
SELECT block_number, log_index, CASE WHEN block_number % 10 IN (1, 2) THEN 'data is short or malformed' WHEN block_number % 10 IN (3, 4) THEN 'topics are missing or malformed' END AS error,
  CASE WHEN block_number % 10 NOT IN (1, 2, 3, 4) THEN {_VALUE} END AS value, count(*) AS n FROM moves_raw GROUP BY ALL"""))
def snk5(spark, sf):
    rows, dead = A.split_decoded(D.decode_logs(malformed(spark, sf), TRANSFER_INPUTS, limbs=True))
    both = rows.select("block_number", "log_index", big("value")).unionByName(
        dead.select("block_number", "log_index", "error"), allowMissingColumns=True)
    return both.groupBy("block_number", "log_index", "value", "error").agg(F.count("*").alias("n"))


_LOST = """CASE WHEN block_number % 10 IN (1, 2) THEN 'data is short or malformed' WHEN block_number % 10 IN (3, 4) THEN 'topics are missing or malformed' END"""


@query("snk3_ingest_stream", sql(["moves_raw"], f"""
WITH r AS (SELECT *, {_LOST} AS error FROM moves_raw QUALIFY row_number() OVER (PARTITION BY block_number, log_index
  ORDER BY CASE WHEN block_number % 10 = 5 THEN 0 ELSE value END, to_addr) = 1)
SELECT block_number, log_index, CASE WHEN error IS NULL THEN from_addr END AS "from", CASE WHEN error IS NULL THEN to_addr END AS "to",
  CASE WHEN error IS NULL THEN {_VALUE} END AS value, error FROM r"""))
def snk3_stream(spark, sf):
    """All raw logs as a stream of files into the archive, and the whole stream once more under the same batch ids."""
    archive = ingested(spark, sf, times=2)
    rows = named_rows(archive).select("block_number", "log_index", F.col("from_addr").alias("from"), F.col("to_addr").alias("to"), big("value"))
    return rows.unionByName(archive.read("dead").select("block_number", "log_index", "error"), allowMissingColumns=True)


def ingested(spark, sf, times: int = 1):
    """An archive of all raw logs, malformed and oversized ones included, read as a stream of files."""
    path = f"{new_folder(spark, 'raw')}/logs"
    files = 6 * -(-T.table(spark, sf, "lineitem").count() // 6_000_000)
    with cleaning(spark):
        malformed(spark, sf, T.lines_by_block(spark, sf, files)).write.option("compression", CODEC).parquet(path)
    catalog = spark.createDataFrame([(f"c{i}", a, "Transfer", V.TRANSFER_TOPIC, f"c{i}_transfer") for i, a in enumerate(T.CONTRACTS)],
                                    "contract string, address string, event string, topic0 string, table_name string")
    archive = A.Archive(spark, new_folder(spark, "archive"), A.MIN_SIZE)
    schema = spark.read.parquet(path).schema
    for _ in range(times):
        ingest(L.stream_logs(spark, path, schema, max_files=files // 3), catalog, archive, new_folder(spark, "ingest"), ["value", "to_addr"])
    return archive


def named_rows(archive):
    """Rows of an archive with addresses for ids."""
    return looked_up(archive.read("rows"), {"from_id": "from_addr", "to_id": "to_addr"}, archive.read("addresses"), "id", "address")


@query("snk6_capture", sql(["moves", "ctx"], """
WITH r AS (SELECT *, row_number() OVER (ORDER BY block_number, log_index) AS n FROM moves)
SELECT r.block_number, r.log_index, CAST(r.value AS VARCHAR) AS value, c.selector, CAST(len(c.topics) AS INTEGER) AS n_topics
FROM r LEFT JOIN ctx c ON c.tx_hash = r.tx_hash WHERE n % 3 = 0"""))
def snk6(spark, sf):
    items = global_rank(T.moves(spark, sf).select("block_number", "log_index", "tx_hash", "value"), ["block_number", "log_index"])
    path = new_folder(spark, "capture")
    A.store_capture(items, T.tx_ctx(spark, sf).select("tx_hash", "ctx"), path, every=3)
    return A.load_capture(spark, path).select("block_number", "log_index", num("value"), "ctx.selector", F.size("ctx.topics").alias("n_topics"))


def _schemas(spark, sf):
    """A table per part; each archive lacks some of the columns a reader needs."""
    part = T.table(spark, sf, "part").select("p_partkey", "p_size")
    cols = F.explode(F.array(*[F.lit(c) for c in ("block_number", "log_index", "value", "lane")])).alias("column_name")
    name = F.concat(F.lit("t"), F.col("p_partkey").cast("string"))
    required = part.select(name.alias("table_name"), (F.col("p_partkey") % 4 == 0).alias("optional"), cols)
    present = part.filter("p_partkey % 8 <> 0").select(name.alias("table_name"), "p_size", cols).filter(
        "NOT (column_name = 'lane' AND p_size % 3 = 0) AND NOT (column_name = 'value' AND p_size % 5 = 0)").drop("p_size")
    return required, present


@query("snk8_schema_gaps", sql([], """
WITH c AS (SELECT p_partkey, p_size, unnest(['block_number', 'log_index', 'value', 'lane']) AS column_name FROM part)
SELECT 't' || CAST(p_partkey AS VARCHAR) AS table_name, column_name FROM c
WHERE (p_partkey % 8 <> 0 AND ((column_name = 'lane' AND p_size % 3 = 0) OR (column_name = 'value' AND p_size % 5 = 0)))"""))
def snk8(spark, sf):
    return A.schema_gaps(*_schemas(spark, sf)).select("table_name", "column_name")


@query("snk9_check_meta", sql([], """
WITH s AS (SELECT c_custkey, 'schema' || CAST(c_custkey AS VARCHAR) AS scope FROM customer)
SELECT scope, 'layout' AS key, CASE WHEN c_custkey % 3 = 0 THEN '2' WHEN c_custkey % 7 = 0 THEN '1' ELSE '2' END AS value,
  c_custkey % 3 <> 0 AND c_custkey % 7 = 0 AS refused FROM s
UNION ALL
SELECT scope, 'partition_blocks', CASE WHEN c_custkey % 3 = 0 THEN CAST(10000 * (1 + c_custkey % 2) AS VARCHAR)
    WHEN c_custkey % 5 = 0 THEN '20000' ELSE '10000' END,
  c_custkey % 3 <> 0 AND (CASE WHEN c_custkey % 5 = 0 THEN '20000' ELSE '10000' END) <> CAST(10000 * (1 + c_custkey % 2) AS VARCHAR) FROM s"""))
def snk9(spark, sf):
    """One archive per customer: a third is new, the rest keep what they stored first."""
    s = T.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("schema"), F.col("c_custkey").cast("string")).alias("scope"))
    k = F.col("c_custkey")
    layout = s.select("c_custkey", "scope", F.lit("layout").alias("key"), F.when(k % 7 == 0, "1").otherwise("2").alias("value"))
    width = s.filter("c_custkey % 5 = 0").select("c_custkey", "scope", F.lit("partition_blocks").alias("key"), F.lit("20000").alias("value"))
    stored = layout.unionByName(width).filter("c_custkey % 3 <> 0").drop("c_custkey")
    wanted = s.select("scope", F.lit("layout").alias("key"), F.lit("2").alias("value")).unionByName(
        s.select("scope", F.lit("partition_blocks").alias("key"), (10000 * (1 + k % 2)).cast("string").alias("value")))
    legacy = spark.createDataFrame([("partition_blocks", "10000")], "key string, value string")
    return A.check_meta(stored, wanted, legacy)


@query("snk10_hex_view", sql(["moves", "blocks"], """
SELECT m.block_number, strftime(b.block_time, '%Y-%m-%d %H:%M:%S') AS block_time, m.tx_hash, m.log_index,
  m.from_addr AS "from", CASE WHEN m.contract_no <> 2 THEN m.to_addr END AS "to", CAST(m.value AS VARCHAR) AS value
FROM moves m LEFT JOIN blocks b USING (block_number)"""))
def snk10(spark, sf):
    moves = T.moves(spark, sf)
    ids = stored(assign_ids(spark.createDataFrame([], "id bigint, address string"), moves, ["from_addr", "to_addr"]), "ids")
    events = swap_ids(moves, {"from_addr": "from_id", "to_addr": "to_id"}, ids).withColumn(
        "tx_hash", F.unhex(F.substring("tx_hash", 3, 64)))
    # an id the dictionary does not hold must not lose the row
    events = events.withColumn("to_id", F.when(F.col("contract_no") == 2, -1).otherwise(F.col("to_id")))
    events = stored(events.select("block_number", "log_index", "tx_hash", "from_id", "to_id", "value"), "events")
    book = ids.withColumn("address", F.unhex(F.substring("address", 3, 40)))
    view = A.hex_view(events, T.blocks(moves), book, [("from_id", "from", "address"), ("to_id", "to", "address"), ("value", "value", "uint256")])
    return view.select("block_number", ts("block_time"), "tx_hash", "log_index", "from", "to", num("value"))
