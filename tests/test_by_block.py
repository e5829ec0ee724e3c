"""Joins that keep a block's rows together, so that hashes, addresses and texts are not dealt over all tasks."""

import os
import re
from contextlib import contextmanager
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chainloom.functions import vocab as V
from chainloom.operators import enrich as E
from chainloom.operators import explore as X
from chainloom.operators import lanes as N
from chainloom.operators import sentences as S
from chainloom.plans import frames
from chainloom.session import shared_root, stored
from chainloom.sources import archive as A
from chainloom.sources import testdata as T

SF = "/root/testdata/sf0.001"


@contextmanager
def plain_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def dealt_by(df):
    """The keys by which the plan deals rows."""
    return {k for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString()) for k in re.findall(r"([a-z_]+)#", keys)}


@pytest.mark.parametrize("build", [frames.described, frames.live])
def test_described_rows_stay_by_block(spark, build):
    with plain_joins(spark):
        keys = dealt_by(build(spark, SF).select("block_number", "log_index", "tx_hash", "from_addr", "to_addr", "sentence", "ruled"))
    assert "tx_hash" not in keys and "_party" not in keys and "l_orderkey" in keys


def test_contexts_of_a_block_find_their_rows(spark):
    """Two transactions of a block, one without a context, one unknown."""
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "c"), (3, 1, None)], "block_number bigint, log_index int, tx_hash string")
    said = spark.createDataFrame([("a", 1, "x"), ("b", 1, None), ("z", 2, "y")], "tx_hash string, block_number bigint, fact string")
    got = S.with_context(rows, said).orderBy("block_number", "log_index").select("tx_hash", "fact").collect()
    assert got == [("a", "x"), ("b", None), ("a", "x"), ("c", None), (None, None)]


def test_a_party_on_both_sides_and_twice(spark):
    rows = spark.createDataFrame([(1, 1, "0xa", "0xa"), (1, 2, "0xb", "0xa"), (2, 1, "0xa", V.ZERO_ADDRESS), (2, 2, None, "0xu")], "block_number bigint, log_index int, from_addr string, to_addr string")
    kinds = spark.createDataFrame([("0xa", True), ("0xb", False), ("0xu", None)], "address string, is_contract boolean")
    got = S.with_kinds(rows, kinds).orderBy("block_number", "log_index").select("from_kind", "to_kind").collect()
    assert got == [(True, True), (False, True), (True, None), (None, None)]


def test_only_columns_that_are_read_are_written(spark):
    root = shared_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    frames.scored(spark, SF, columns=frames.PLACE)
    folder = next(f for f in set(os.listdir(root)) - before if f.startswith("described-"))
    assert sorted(spark.read.parquet(f"{root}/{folder}").columns) == ["block_number", "log_index", "ruled", "sentence"]


def test_few_answers_move_no_row(spark):
    rows = stored(spark.range(100).select(F.col("id").alias("block_number"), F.lit(1).alias("log_index"), F.lit("a").alias("sentence"), F.lit("").alias("ruled")), "rows")
    with plain_joins(spark):
        assert dealt_by(N.settle(rows, spark.createDataFrame([("a", "swap", None)], N.ANSWERS))) == set()


def test_lanes_come_by_block(spark):
    moves = T.moves(spark, SF)
    lanes = stored(moves.select("block_number", "log_index", F.lit("swap").alias("lane")).filter("log_index <> 2"), "lanes")
    with plain_joins(spark):
        assert "log_index" not in dealt_by(X.block_messages(moves, lanes, -1, 1 << 40))
        keys = dealt_by(X.recent_lanes(moves, lanes))
        assert "log_index" not in keys and "_slice" not in keys and "address" in keys


def test_recent_rows_without_a_lane_take_a_place(spark):
    rows = spark.createDataFrame([(b, 1, "0xa", "0xa" if b == 5 else "0xb") for b in range(6)], "block_number bigint, log_index int, from_addr string, to_addr string")
    lanes = spark.createDataFrame([(b, 1, "swap" if b < 4 else "spam") for b in range(6) if b != 4], "block_number bigint, log_index int, lane string")
    got = sorted(tuple(r) for r in X.recent_lanes(rows, lanes, 3).select("address", "lane", "n").collect())
    assert got == [("0xa", "spam", 1), ("0xa", "swap", 1), ("0xb", "swap", 2)]


def test_mirrors_move_by_transaction_only(spark):
    rows = stored(T.moves(spark, SF).select("tx_hash", "from_addr", "to_addr", "log_index", "value"), "moves")
    with plain_joins(spark):
        assert dealt_by(E.drop_mirrors(rows.filter("log_index < 3"), rows)) == {"tx_hash"}


def test_mirrors_of_long_transactions_and_missing_parties(spark):
    s = "tx_hash string, from_addr string, to_addr string, log_index int, value decimal(38,0)"
    native = [("t", "a", "b", i * 40_000, Decimal(10**12)) for i in range(5)] + [("t", None, "b", 7, Decimal(10**12))]
    erc = [("t", "a", "b", i, Decimal(1)) for i in range(3)] + [("t", None, "b", 9, Decimal(1))]
    left = E.drop_mirrors(spark.createDataFrame(erc, s), spark.createDataFrame(native, s)).collect()
    assert sorted(r["log_index"] for r in left) == [7, 120_000, 160_000]


def test_ids_come_by_block(spark):
    rows = stored(T.moves(spark, SF), "moves")
    ids = stored(E.assign_ids(spark.createDataFrame([], "id bigint, address string"), rows, ["from_addr", "to_addr"]), "ids")
    with plain_joins(spark):
        out = E.swap_ids(rows, {"from_addr": "from_id", "to_addr": "to_id"}, ids)
        view = A.hex_view(out, T.blocks(rows), ids.withColumn("address", F.unhex(F.substring("address", 3, 40))), [("from_id", "from", "address")])
        assert not {"from_addr", "to_addr", "from_id", "to_id", "log_index"} & dealt_by(view)


def test_the_end_of_a_large_range_is_no_top_k(spark, monkeypatch):
    """A task holds its top-k: a quarter of all rows would be too many."""
    sizes = {1: 3, 2: 2, 4: 9, 5: 1, 6: 1}
    rows = spark.createDataFrame([(b,) for b, n in sizes.items() for _ in range(n)], "block_number bigint")
    plan = N.cap_range(rows, F.lit(1), F.lit(9), 10**8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan
    for lo in (0, 3):
        for most in (3, 5, 14, 17):
            ends = []
            for first in (10**6, 0):
                monkeypatch.setattr(N, "FIRST_ROWS", first)
                ends.append(N.cap_range(rows, F.lit(lo), F.lit(9), most).first()["to"])
            assert ends[0] == ends[1]


def test_a_few_sentences_and_labels_move_no_row(spark):
    rows = stored(spark.range(100).select(F.col("id").alias("block_number"), F.lit(1).alias("log_index"), F.lit("a").alias("sentence"), F.lit("m").alias("model")), "rows")
    book = stored(spark.createDataFrame([(1, "a", "m", None)], N.SENTENCES), "book")
    with plain_joins(spark):
        assert dealt_by(N.with_sentence_ids(rows, book)) == set()
