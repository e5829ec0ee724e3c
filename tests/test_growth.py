"""Plans whose largest task, or work per row, must not grow faster than the input."""

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from chainloom.functions import vocab as V
from chainloom.operators import catalog as C
from chainloom.operators import decode as D
from chainloom.operators import lanes as N
from chainloom.operators import sentences as S
from chainloom.plans import registry
from chainloom.plans.archive_queries import ingested
from chainloom.session import CLEANUP, new_folder, shared_root, stored
from chainloom.sources import archive as A
from chainloom.sources import logs as L
from chainloom.sources.tablelog import File
from chainloom.streaming import ingest as I


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_abi_is_read_once(spark):
    row = [("aB c", "0xA", '[{"type":"event","name":"A","topic0":"0x1234567890","inputs":[{"name":"blockNumber","type":"bool"}]}]', None)]
    abis = spark.createDataFrame(row, "contract string, address string, abi string, selected array<string>")
    out = C.event_columns(C.event_catalog(abis))
    assert optimized(out).count("from_json") == 1
    assert out.collect() == [("a_b_c_a", 0, "param_block_number", "param_block_number", "bool", False)]


def test_abis_are_made_in_many_tasks(spark):
    assert registry.queries()["dec3_event_columns"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_configuration_is_never_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        logs = spark.createDataFrame([(V.USDC, [V.TRANSFER_TOPIC], 5)], "address string, topics array<string>, block_number bigint")
        starts = spark.createDataFrame([(V.USDC, 1)], "address string, start_block bigint")
        events = spark.createDataFrame([("c", V.USDC, "Transfer", V.TRANSFER_TOPIC, "t")], "contract string, address string, event string, topic0 string, table_name string")
        functions = spark.createDataFrame([("c", V.USDC, "0x1", "f")], "contract string, address string, selector string, name string")
        calls = logs.select(F.struct(F.col("address").alias("to"), F.lit("0x1").alias("selector")).alias("ctx"))
        for df in (L.apply_start(logs, starts, F.lit(9)), D.route(logs, events), S.with_calls(calls, functions)):
            assert "BroadcastHashJoin" in physical(df) and "SortMergeJoin" not in physical(df) and df.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_without_a_party_spread(spark):
    """All rows lack their parties or name the zero address: no task of the joins by party gets them all."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(4000).select(F.col("id").alias("block_number"), F.lit(1).alias("log_index"), F.when(F.col("id") % 2 == 0, V.ZERO_ADDRESS).alias("from_addr"),
                                        F.lit(V.ZERO_ADDRESS).alias("to_addr"))
        kinds = spark.createDataFrame([("0xa", True)], "address string, is_contract boolean")
        sizes = [len(p) for p in S.with_kinds(rows, kinds).rdd.glom().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_kinds_of_parties(spark):
    rows = spark.createDataFrame([(1, 1, "0xa", "0xb"), (1, 2, None, V.ZERO_ADDRESS), (2, 1, "0xc", None)], "block_number bigint, log_index int, from_addr string, to_addr string")
    kinds = spark.createDataFrame([("0xa", True), ("0xb", False)], "address string, is_contract boolean")
    got = S.with_kinds(rows, kinds).orderBy("block_number", "log_index").select("from_addr", "to_addr", "from_kind", "to_kind").collect()
    assert got == [("0xa", "0xb", True, False), (None, V.ZERO_ADDRESS, None, None), ("0xc", None, None, None)]


def test_settled_answers_are_a_table(spark):
    """An aggregate beside the rows of a hot sentence keeps adaptive execution from splitting them."""
    rows = spark.createDataFrame([("a", ""), ("a", ""), ("b", "spam")], "sentence string, ruled string")
    answers = rows.filter("ruled = ''").select("sentence").distinct().select("sentence", F.lit("swap").alias("choice"), F.lit(None).cast(N.PROBS).alias("probs"))
    out = N.settle(rows, answers)
    assert "Aggregate" not in optimized(out)
    assert out.count() == 3 and out.filter("ruled = 'spam'").first()["lane"] == "spam"


def test_rows_of_one_sentence_spread(spark):
    """All rows say one sentence: no task of the join with its answer gets them all, and each row its answer once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = stored(spark.range(4000).select(F.col("id").alias("block_number"), F.lit(1).alias("log_index"), F.lit("a").alias("sentence"), F.lit("").alias("ruled")), "rows")
        answers = spark.createDataFrame([("a", "swap", None)], N.ANSWERS)
        sizes = [len(p) for p in N.settle(rows, answers).rdd.glom().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 3000
        assert N.settle(rows, answers).groupBy("block_number", "choice").count().filter("count = 1 AND choice = 'swap'").count() == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_replayed_stream_is_not_decoded(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(I, "decode_logs", lambda *a, f=I.decode_logs, **b: calls.append(1) or f(*a, **b))
    before = set(os.listdir(shared_root(spark).removeprefix("file:")))
    archive = ingested(spark, "/root/testdata/sf0.001", times=2)
    assert len(calls) == archive.log.facts["batch_id"] + 1
    # the decoded batch is a written table already; a commit makes no copy of it
    assert not [f for f in set(os.listdir(shared_root(spark).removeprefix("file:"))) - before if f.startswith("incoming")]
    txs = archive.read("transactions")
    assert txs.count() == txs.distinct().count() == archive.read("rows").select("tx_hash").distinct().count()


def test_tables_stored_by_threads_leave_the_setting(spark):
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: stored(spark.range(1000 * i), f"t{i}"), range(1, 9)))
    assert spark.conf.get(CLEANUP) == "false"


def chain_rows(spark, lo, hi):
    """Eight logs to a block, two transactions in it, every tenth log without a receiver; each log twice."""
    i = F.col("id")
    block = F.expr("id div 8")
    return stored(spark.range(8 * lo, 8 * hi).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        block.alias("block_number"), (i % 8).cast("int").alias("log_index"), F.concat(F.lit("t"), block.cast("string"), F.lit("-"), (i % 2).cast("string")).alias("tx_hash"),
        F.concat(F.lit("a"), (i % 90).cast("string")).alias("from_addr"), F.when(i % 10 > 0, F.concat(F.lit("b"), (i % 70).cast("string"))).alias("to_addr"),
        (i * 2 + F.col("copy")).cast("decimal(38,0)").alias("value"), F.concat(F.lit("h"), block.cast("string")).alias("block_hash"), F.timestamp_seconds(block).alias("block_time")), "chain")


def test_a_commit_keeps_a_block_together(spark):
    """Rows of a block repeat its hashes: dealt over tasks one by one, each would carry them through every shuffle and file."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    root = shared_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    try:
        a, none = A.Archive(spark, new_folder(spark, "together"), 10_000), spark.createDataFrame([], A.Archive.DEAD)
        assert a.commit_batch(chain_rows(spark, 0, 200), none, 199, 0, ["value"]) == 1600
        assert a.commit_batch(chain_rows(spark, 150, 300), none, 299, 1, ["value"]) == 800  # 50 blocks are known
        for name in ("batch", "filed"):
            for folder in set(os.listdir(root)) - before:
                if folder.startswith(f"{name}-"):
                    rows = spark.read.parquet(f"{root}/{folder}").select("block_number", F.input_file_name().alias("file"))
                    assert rows.distinct().count() == rows.select("block_number").distinct().count() > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    ids = a.read("addresses")
    names = {s: ids.select(F.col("id").alias(f"{s}_id"), F.col("address").alias(f"{s}_addr")) for s in ("from", "to")}
    got = a.read("rows").join(names["from"], "from_id", "left").join(names["to"], "to_id", "left").select("block_number", "log_index", "tx_hash", "from_addr", "to_addr")
    want = chain_rows(spark, 0, 300).filter("value % 2 = 0").select(got.columns)
    assert got.count() == 2400 and want.exceptAll(got).count() == 0
    txs = a.read("transactions").select("tx_hash", "block_number")
    assert txs.count() == 600 and want.select(txs.columns).distinct().exceptAll(txs).count() == 0


def test_a_run_is_not_merged_with_itself(spark):
    """A batch that is written as many small files would be written again after every commit, with all before it."""
    a = A.Archive(spark, new_folder(spark, "due"), 10_000, fan=3)
    for n, run in enumerate(("r1", "r2", "r3")):
        for i in range(9):
            path = f"{run}-{i}"
            a.log.live.setdefault("rows", {})[path] = File(path, 9 * n + i, 9 * n + i, 50_000, run)
        assert len(a._due("rows")) == (27 if run == "r3" else 0)
