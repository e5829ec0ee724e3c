"""Silence is told by the clock: without further rows, once per feed, and across a restart."""

import datetime as dt
import time

from chainloom.streaming.live import watch_feeds

SCHEMA = "feed string, seen timestamp"


def test_silent_feeds_are_told_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def put(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def start():
        return (watch_feeds(spark.readStream.schema(SCHEMA).parquet(source), stale=6).writeStream.format("parquet")
                .option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start())

    def told():
        try:
            rows = spark.read.schema("feed string, alive boolean, last timestamp").parquet(out).collect()
        except Exception:
            return []
        return sorted((r.feed, r.alive, r.last) for r in rows) if all(r.last for r in rows) else sorted(
            (r.feed, r.alive, r.last or dt.datetime.min) for r in rows)

    def wait(n, query, limit=60):
        end = time.time() + limit
        while time.time() < end and len(told()) < n:
            assert query.exception() is None
            time.sleep(0.5)
        return told()

    one, two = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    put(("a", one), ("a", two), ("b", one), ("named only", None), (None, one))
    query = start()
    try:
        assert [r[:2] for r in wait(3, query)] == [("a", True), ("b", True), ("named only", True)]
        seen = wait(6, query)
        assert [r[:2] for r in seen] == [(f, alive) for f in ("a", "b", "named only") for alive in (False, True)]
        assert {r[2] for r in seen if r[0] == "a"} == {two} and {r[2] for r in seen if r[0] == "named only"} == {dt.datetime.min}
        put(("a", one))  # comes back; what it saw last stays the latest
        assert [r for r in wait(7, query) if r[0] == "a"].count(("a", True, two)) == 2
    finally:
        query.stop()
    time.sleep(6)  # the deadline passes while nothing runs
    query = start()
    try:
        assert [r[:2] for r in wait(8, query)].count(("a", False)) == 2
        time.sleep(3)
        assert len(told()) == 8  # nothing is told twice
    finally:
        query.stop()
