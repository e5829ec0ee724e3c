"""The archive's log: whole commits, files read, compaction, point lookups and two writers."""

import pytest
from pyspark.sql import functions as F

from chainloom.functions.wide import wide_narrow
from chainloom.operators import explore as Q
from chainloom.session import new_folder
from chainloom.sources import archive as A
from chainloom.sources.tablelog import Conflict, File, TableLog


def rows(spark, lo, hi, rare="rare"):
    """One row per block: a hot receiver, senders that come and go, and one address in every 997th block."""
    i = F.col("id")
    return spark.range(lo, hi).select(
        i.alias("block_number"), F.lit(1).alias("log_index"), F.concat(F.lit("t"), i.cast("string")).alias("tx_hash"),
        F.when(i % 997 == 0, rare).otherwise(F.concat(F.lit("a"), (i % 400 + i / 3).cast("int").cast("string"))).alias("from_addr"), F.lit("hot").alias("to_addr"),
        i.cast("decimal(38,0)").alias("value"), F.concat(F.lit("h"), i.cast("string")).alias("block_hash"), F.timestamp_seconds(i).alias("block_time"))


@pytest.fixture(scope="module")
def grown(spark):
    """16 commits with compaction; what commits and lookups opened after each fourth."""
    none = spark.createDataFrame([], A.Archive.DEAD)
    a = A.Archive(spark, new_folder(spark, "grown"), 10_000, fan=3, file_rows=4_000)
    opened, step = [], 1_000
    for n in range(16):
        a.commit_batch(rows(spark, n * step, (n + 1) * step), none, (n + 1) * step - 1, n, ["value"])
        commit = a.opened
        a.compact()
        if n % 4 == 3:
            page = Q.address_page(a, "hot").collect()
            assert [r.block_number for r in page] == list(range((n + 1) * step - 1, (n + 1) * step - 26, -1)) and page[-1].older
            hot = a.opened
            assert [r.block_number for r in a.transaction("t123").collect()] == [123]
            opened.append((commit, hot, a.opened, len(a.log.files("rows")), len(a.log.runs("names"))))
    return a, opened


def test_files_read_do_not_grow_with_the_archive(grown):
    a, opened = grown
    assert max(c for c, *_ in opened) <= 25 and max(h for _, h, *_ in opened) <= 25 and max(t for _, _, t, *_ in opened) <= 12
    assert opened[-1][1] <= opened[0][1] + 6 and opened[-1][2] <= opened[0][2] + 4
    assert len(a.log.files("rows")) < 20 and len(a.log.runs("names")) <= 12
    assert a.read("rows").count() == 16_000 and a.read("rows").select("block_number").distinct().count() == 16_000
    ids = [r["id"] for r in a.read("addresses").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1)) and a.cursor().first()["last_id"] == len(ids)
    assert a.read("postings").filter("id = 1 OR id = 2").agg(F.sum("n")).first()[0] >= 16_000


def test_plans_of_many_commits(spark):
    """300 commits at the log alone: what is due for merging keeps the files that a lookup meets to a few per size."""
    a = A.Archive(spark, new_folder(spark, "plans"), fan=4, file_rows=1_000)
    met = []
    for n in range(300):
        a.log.commit([("rows", File(f"/r{n}", n * 100, n * 100 + 99, 100, f"r{n}")), ("names", File(f"/n{n}", -(1 << 63), (1 << 63) - 1, 150, f"n{n}"))])
        for table in ("rows", "names"):
            due = a._due(table)
            total = sum(f.rows for f in due)
            lo, hi = min((f.lo for f in due), default=0), max((f.hi for f in due), default=0)
            many = -(-total // a.file_rows)
            width = (hi - lo + 1) // max(1, many)
            merged = [File(f"/{table}{n}-{i}", lo + i * width, hi if i == many - 1 else lo + (i + 1) * width - 1, total // many, f"m{n}") for i in range(many)]
            if due:
                a.log.commit([(table, f) for f in merged], [(table, f.path) for f in due])
        met.append((len(a.log.files("names", [(5, 5)])), len(a.log.files("rows", [(n * 100, n * 100 + 99)])), len(a.log.files("rows"))))
    assert max(m[0] for m in met) <= 4 * 8 and max(m[1] for m in met) <= 2
    assert met[-1][2] <= 300 * 100 / 500 + 4
    assert TableLog(spark, a.log.root).live == a.log.live


def test_pages_by_index_equal_pages_by_scan(spark, grown):
    a, _ = grown
    moves = rows(spark, 0, 16_000)
    columns = ["address", "block_number", "log_index", "tx_hash", "dir", "counterparty", "value", "time", "older"]
    for who in ("rare", "hot", "a7", "nobody"):
        for before in (None, (9_000, 1), (8_973, 1), (3, 0), (0, 0)):
            got = Q.address_page(a, who, before).select(columns)
            want = Q.address_history(moves, address=who, before=before).select(columns)
            got = got.withColumn("value", wide_narrow(F.col("value")))
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (who, before)
    assert Q.transaction_page(a, "nothing").count() == 0
    assert Q.transaction_page(a, "t15999").select("from_addr", "to_addr", "time").first()[1:] == ("hot", 15_999)


def test_a_reopened_archive_and_a_replay(spark, grown):
    a, _ = grown
    again = A.Archive(spark, a.log.root, 10_000, fan=3, file_rows=4_000)
    assert again.log.version == a.log.version and again.log.live == a.log.live and again.log.facts == a.log.facts
    assert len(again.log._names()) <= 3 * TableLog.EVERY + 2
    before = {t: sorted(f.path for f in a.log.files(t)) for t in a.TABLES}
    none = spark.createDataFrame([], A.Archive.DEAD)
    assert again.commit_batch(rows(spark, 0, 1_000), none, 999, 0, ["value"]) == 0  # long since merged into other files
    assert {t: sorted(f.path for f in a.log.refresh().files(t)) for t in a.TABLES} == before


def test_a_reader_during_compaction_sees_one_state(spark):
    a = A.Archive(spark, new_folder(spark, "state"), 10_000, fan=3, file_rows=1_000)
    none = spark.createDataFrame([], A.Archive.DEAD)
    for n in range(3):
        a.commit_batch(rows(spark, n * 50, n * 50 + 50), none, n * 50 + 49, n, ["value"])
    planned = a.read("rows")
    book = a.read("names")
    held = a.log.version
    assert a.compact()["rows"] >= 3
    assert planned.count() == 150 and a.read("rows").count() == 150
    assert sorted(map(tuple, book.collect())) == sorted(map(tuple, a.read("names").collect()))
    assert a.log.vacuum(held) == [] and a.read("rows").count() == 150
    removed = a.log.vacuum(a.log.version)
    assert removed and a.read("rows").count() == 150 and a.log.gone == {}
    assert A.Archive(spark, a.log.root).read("rows").count() == 150


def test_two_writers(spark):
    root = new_folder(spark, "two")
    one, two = TableLog(spark, root), TableLog(spark, root)
    file = lambda n: File(f"/f{n}", n, n, 1, f"r{n}")
    one.commit([("t", file(1))], facts={"batch_id": 0})
    two.commit([("t", file(2))])  # taken in and put on top
    assert two.version == 1 and sorted(f.path for f in one.refresh().files("t")) == ["/f1", "/f2"]
    late = TableLog(spark, root)
    one.commit([("t", file(4))], facts={"batch_id": 1})
    with pytest.raises(Conflict):
        late.commit([("t", file(5))], facts={"batch_id": 1})  # the same batch by another writer
    one.commit([("t", file(6))], [("t", "/f1"), ("t", "/f2")])
    with pytest.raises(Conflict):
        late.commit([("t", file(7))], [("t", "/f1")])  # another compaction took it
    assert not late.files("t", [(7, 7)])
    for n in range(10, 50):
        one.commit([("t", file(n))])
    assert late.refresh().live == one.live and TableLog(spark, root).live == one.live
    assert [f.path for f in late.files("t", [(20, 22), (40, 40)])] == ["/f20", "/f21", "/f22", "/f40"]


def test_counters_come_with_the_commits(spark):
    a = A.Archive(spark, new_folder(spark, "counted"), 10_000)
    lost = spark.createDataFrame([(3, "t", 1, "a", [], "0x", "short")] * 2, "block_number bigint, tx_hash string, log_index int, address string, topics array<string>, data string, error string")
    for batch_id in (0, 0, 1):
        a.commit_batch(rows(spark, 0, 30), lost, 29, batch_id, ["value"])
    got = {r["name"]: r.n for r in a.counters().collect()}
    assert got == {"received": 64, "inserted": 30, "dead_letters": 1, "blocks": 30, "addresses": a.cursor().first()["last_id"]}


def test_too_many_avoided_words_are_refused(spark):
    from chainloom.operators import dataset as S
    texts = spark.createDataFrame([("a fine text",)], "text string")
    words = spark.createDataFrame([(f"w{i}",) for i in range(6)], "word string")
    assert S.leaks(texts, texts, words, most=6).first()["leaked"]
    with pytest.raises(Exception, match="more than 5 avoided words"):
        S.leaks(texts, texts, words, most=5).collect()
