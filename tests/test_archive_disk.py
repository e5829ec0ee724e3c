"""What an archive's jobs leave behind, and what they deal over tasks."""

import glob
import os

import pyarrow.parquet as pq

import test_growth
from chainloom.plans.archive_queries import archive_of, archive_rows, ingested, named_rows
from chainloom.session import shared_root
from chainloom.sources import archive as A
from chainloom.sources import testdata as T

from test_by_block import SF, dealt_by, plain_joins


def left_since(spark, before):
    return {f.rsplit("-", 1)[0] for f in set(os.listdir(shared_root(spark).removeprefix("file:"))) - before}


def test_a_stream_leaves_its_archive_only(spark):
    before = set(os.listdir(shared_root(spark).removeprefix("file:")))
    archive = ingested(spark, SF)
    assert archive.read("rows").count() > 0 and archive.read("dead").count() > 0
    assert not {"decoded", "batch", "fresh", "filed"} & left_since(spark, before)


def test_replaced_files_go_and_names_come_by_block(spark):
    rows = archive_rows(spark, SF)
    archive = archive_of(spark, rows, 3, fan=2)
    live = {f.path.rsplit("/", 1)[1] for table in archive.TABLES for f in archive.log.files(table)}
    on_disk = {os.path.basename(p): p for p in glob.glob(f"{archive.root.removeprefix('file:')}/*/run=*/**/*.parquet", recursive=True)}
    assert live <= set(on_disk) and not archive.log.gone
    assert sum(pq.read_metadata(p).num_rows for f, p in on_disk.items() if f not in live) == 0  # a write without rows leaves a file
    named = named_rows(archive).select("block_number", "log_index", "from_addr", "to_addr")
    assert rows.select(named.columns).exceptAll(named).count() == 0 and named.count() == rows.count()
    with plain_joins(spark):
        assert not {"from_id", "to_id"} & dealt_by(named)


def test_lines_are_dealt_before_hashes_are_made(spark):
    plan = T.raw_logs(spark, SF, T.lines_by_block(spark, SF, 6))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2") < plan.index("RepartitionByExpression") and "sha2" not in plan[plan.index("RepartitionByExpression"):]


def test_a_block_stays_together_in_tables_that_go_later(spark, monkeypatch):
    monkeypatch.setattr(A, "discard", lambda *frames: None)
    test_growth.test_a_commit_keeps_a_block_together(spark)
