"""Values of great length and the key that is used where none is given."""

import re
import time

import pytest

from chainloom.llm import pii


def hidden(spark, texts, **how):
    rows = pii.pseudonymized(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **how).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("size", [100, 800, 20_000])
def test_long_values_end(spark, size):
    local = ("Ab-c9.x_7" * size)[:size - 1] + "z"
    other = "B" + local[1:]
    begin = time.time()
    got = hidden(spark, [f"to {local}@a.com now", f"again {local}@a.com", f"{other}@a.com"], key="k")
    assert time.time() - begin < 30
    new = re.fullmatch(r"to (\S+)@a\.com now", got[0]).group(1)
    shape = lambda t: re.sub("[a-z0-9]", "a", re.sub("[A-Z]", "A", t))
    kinds = lambda t: re.sub("[A-Za-z0-9]", "a", t)
    assert kinds(new) == kinds(local) and new != local and got[1] == f"again {new}@a.com"
    assert len(shape(new)) == size and got[2] != f"{new}@a.com"


def test_every_character_is_taken_once(spark):
    df = spark.createDataFrame([("a-b" * 70, "0123456789" * 14), ("", ""), ("--", ""), ("x" * 64, "y" * 64), ("X" * 65, "z" * 65)], "t string, c string")
    got = [r[0] for r in df.select(pii.refilled(df.t, "[^A-Za-z]", df.c)).collect()]
    digits = iter("0123456789" * 14)
    assert got == ["".join(c if c == "-" else next(digits) for c in "a-b" * 70), "", "--", "y" * 64, "Z" * 65]


def test_pieces_are_permuted_one_to_one(spark):
    df = spark.range(1000).selectExpr("concat(repeat('12345', 4), lpad(cast(id as string), 3, '0'), repeat('7', 20)) as t")
    got = [r[0] for r in df.select(pii.permuted(df.t, 10, "k", "card")).collect()]
    assert len(set(got)) == 1000 and all(re.fullmatch("[0-9]{43}", g) for g in got)


def test_no_key_is_written_in_the_source(spark):
    spark.conf.unset(pii.KEY_SETTING)
    text = ["ask john.smith@a.com"]
    first = hidden(spark, text)
    assert first == hidden(spark, text) and len(spark.conf.get(pii.KEY_SETTING)) == 64
    spark.conf.unset(pii.KEY_SETTING)
    assert hidden(spark, text) != first
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert hidden(spark, text) == hidden(spark, text, key="mine")
    spark.conf.unset(pii.KEY_SETTING)
