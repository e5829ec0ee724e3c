"""256-bit values: every operation against Python integers."""

import random

import pytest
from pyspark.sql import functions as F

from chainloom.functions import amounts as M
from chainloom.functions import wide as W
from chainloom.operators import decode as D
from chainloom.operators import explore as X
from chainloom.session import new_folder

EDGES = [0, 1, -1, 10**26 - 1, 10**26, -(10**26), 10**52 - 1, 10**52, -(10**52), -(10**52) - 1, 10**38 - 1, 10**38, -(10**38) + 1, -(10**38), 2**120, 2**128 - 1, 2**255 - 1, -(2**255)]


@pytest.fixture(scope="module")
def values():
    rng = random.Random(6)
    return EDGES + [rng.choice((1, -1)) * rng.getrandbits(rng.randrange(1, 256)) for _ in range(150)]


@pytest.fixture(scope="module")
def frame(spark, values):
    df = spark.createDataFrame([(i, f"{v % (1 << 256):064x}", str(v)) for i, v in enumerate(values)], "i int, word string, digits string")
    return df.withColumn("v", W.wide(F.col("word"), signed=True)).cache()


def test_text_order_and_narrowing(frame, values):
    got = {r.i: r for r in frame.select("i", W.wide_text(F.col("v")).alias("t"), W.wide_narrow(F.col("v")).alias("n"), W.wide_text(W.wide_neg(F.col("v"))).alias("m"),
                                        W.wide_digits(W.wide_abs(F.col("v"))).alias("a"), W.wide_negative(F.col("v")).alias("neg"), W.wide_zero(F.col("v")).alias("z"),
                                        W.wide_double(F.col("v")).alias("d")).collect()}
    for i, v in enumerate(values):
        assert (got[i].t, got[i].m, got[i].a, got[i].neg, got[i].z) == (str(v), str(-v), str(abs(v)), v < 0, v == 0)
        assert (None if got[i].n is None else int(got[i].n)) == (v if abs(v) < 10**38 else None)
        assert got[i].d == pytest.approx(float(v))
    assert [values[r.i] for r in frame.orderBy("v", "i").collect()] == sorted(values)
    assert frame.schema["v"].dataType.simpleString() == W.WIDE


def test_unsigned_words_and_parsing(spark, frame, values):
    got = frame.select("i", W.wide_text(W.wide(F.col("word"))).alias("u"), W.wide_text(W.wide_parse(W.wide_digits(W.wide_abs(F.col("v"))))).alias("p")).collect()
    for r in got:
        assert r.u == str(values[r.i] % (1 << 256)) and r.p == str(abs(values[r.i]))
    small = spark.createDataFrame([(str(v),) for v in EDGES if abs(v) < 10**38], "t string").select("t", W.wide_text(W.wide_of(F.col("t").cast("decimal(38,0)"))).alias("w"))
    assert all(r.t == r.w for r in small.collect())
    assert [r[0] for r in spark.range(1).select(*[W.wide_text(W.wide_lit(v)) for v in EDGES]).collect()] == ["0"]
    row = spark.range(1).select(*[W.wide_text(W.wide_lit(v)).alias(f"c{i}") for i, v in enumerate(EDGES)]).first()
    assert list(row) == [str(v) for v in EDGES]


def test_sums_merge(frame, values):
    assert frame.agg(W.wide_text(W.wide_sum(F.col("v"))).alias("s")).first()["s"] == str(sum(values))
    parts = frame.groupBy((F.col("i") % 7).alias("k")).agg(W.wide_sum(F.col("v")).alias("s"))
    assert parts.agg(W.wide_text(W.wide_sum(F.col("s"))).alias("s")).first()["s"] == str(sum(values))
    assert frame.filter("i < 0").agg(W.wide_sum(F.col("v")).alias("s")).first()["s"] is None
    pairs = frame.alias("a").join(frame.alias("b"), F.expr("b.i = (a.i + 1) % 168")).select(
        F.col("a.i").alias("i"), W.wide_text(W.wide_add(F.col("a.v"), F.col("b.v"))).alias("s"), W.wide_text(W.wide_sub(F.col("a.v"), F.col("b.v"))).alias("d")).collect()
    for r in pairs:
        a, b = values[r.i], values[(r.i + 1) % len(values)]
        assert (r.s, r.d) == (str(a + b), str(a - b))


def test_amounts_of_any_length(spark):
    rows = [(v, d) for v in (0, 1, 4, 5, 999, 10**20 + 5, 2**255, 2**256 - 1) for d in (0, 2, 6, 18, 77)]
    df = spark.createDataFrame([(str(v), d) for v, d in rows], "v string, d int")
    got = df.select("v", "d", M.fmt_amount(M.digits_to_decimal(F.col("v"), F.col("d")), limbs=True).alias("t")).collect()
    for r in got:
        v, d = int(r.v), r.d
        cents = (v * 200 + 10**d) // (2 * 10**d)
        assert r.t == ("<0.01" if v and not cents else f"{cents // 100:,}.{cents % 100:02d}"), (v, d)


def test_no_amount_is_a_dead_letter(spark):
    values = [0, 10**38, 2**256 - 1, -(2**255)]
    logs = spark.createDataFrame([(i, "0x" + f"{v % (1 << 256):064x}", ["0xaa"]) for i, v in enumerate(values)], "i int, data string, topics array<string>")
    got = D.decode_logs(logs, [("value", "int256", False)], limbs=True).select("i", W.wide_text(F.col("row.value")).alias("t"), "error").collect()
    assert all(r.error is None for r in got) and [r.t for r in sorted(got)] == ["0", str(10**38), "-1", str(-(2**255))]
    short = D.decode_logs(logs, [("value", "uint64", False)], limbs=True).schema["row"].dataType["value"].dataType.simpleString()
    assert short == "decimal(38,0)"


def test_totals_and_states_in_limbs(spark):
    top = 2**256 - 1
    rows = [(n, "a" if n % 2 else "b", "c") for n in range(10)]
    df = spark.createDataFrame(rows, "block_number bigint, from_addr string, to_addr string").withColumn("value", W.wide_lit(top)).withColumn(
        "block_time", F.timestamp_seconds(F.col("block_number") * 40_000))
    rollup = X.Rollup(spark, new_folder(spark, "wide"), limbs=True)
    for batch, (lo, hi) in enumerate(((-1, 4), (4, 9), (4, 9))):
        rollup.fold_range(df, None, lo, hi, min(batch, 1))
    daily = rollup.read()
    totals = X.address_totals(daily)
    got = {r.address: (r.i, r.o, r.in_count) for r in totals.select("address", W.wide_text(F.col("in_value")).alias("i"), W.wide_text(F.col("out_value")).alias("o"), "in_count").collect()}
    assert got == {"a": ("0", str(5 * top), 0), "b": ("0", str(5 * top), 0), "c": (str(10 * top), "0", 10)}
    one = X.address_totals(daily, "nobody").select(W.wide_text(F.col("in_value")).alias("i"), "in_count").first()
    assert tuple(one) == ("0", 0)
    net = X.rollup_state(totals.select("address"), totals, F.lit(9), F.lit(9), "2024").select("address", W.wide_text(F.col("net")).alias("n")).collect()
    assert {r.address: r.n for r in net}["a"] == str(-5 * top)
    series = X.day_series(daily).filter("address = 'c'")
    assert series.count() == 5 and series.agg(F.max("in_h")).first()[0] == pytest.approx(82)
