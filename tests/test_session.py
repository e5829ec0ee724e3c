import glob
import os

import pytest

from chainloom.session import CLEANUP, _cleaning, discard, shared_root, stored


def test_stored_tables_go_when_told(spark):
    one, two = stored(spark.range(10), "one"), stored(spark.range(20).groupBy("id").count(), "two")
    root = shared_root(spark).removeprefix("file:")
    folder = two.inputFiles()[0].rsplit("/", 1)[0].rsplit("/", 1)[1]
    assert spark.conf.get(CLEANUP) == "false" and folder in os.listdir(root)
    assert two.join(one, "id").count() == 10
    discard(two.filter("count > 0"))
    assert folder not in os.listdir(root) and one.count() == 10


def test_only_stored_tables_are_removed(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "mine"))
    with pytest.raises(ValueError):
        discard(spark.read.parquet(str(tmp_path / "mine")))
    assert glob.glob(str(tmp_path / "mine" / "*.parquet"))


def test_sessions_put_their_own_setting_back(spark):
    """A stream's batch writes in a copy of the session and may end after the session's own write."""
    other = spark.newSession()
    mine, theirs = _cleaning(spark), _cleaning(other)
    mine.__enter__()
    theirs.__enter__()
    mine.__exit__(None, None, None)
    assert spark.conf.get(CLEANUP) == "false" and other.conf.get(CLEANUP) == "true"
    theirs.__exit__(None, None, None)
    assert other.conf.get(CLEANUP) == "false"
