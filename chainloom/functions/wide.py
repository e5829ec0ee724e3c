"""Signed 256-bit integers as three limbs to the base 10^26: stored, summed, compared and written out exactly.

A value is ``hi * 10^52 + mid * 10^26 + lo`` with ``mid`` and ``lo`` never
negative, so the struct's own order is the order of the values, equal values are
equal structs, and sums of limbs are carried upwards once, however often they
are merged. ``hi`` has 38 digits: some 10^12 of the largest amounts can be added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bigint import BIG, _flipped, u256

WIDE = "struct<hi:decimal(38,0),mid:decimal(26,0),lo:decimal(26,0)>"
LIMB = 10**26


def _base() -> Column:
    return F.lit(str(LIMB)).cast("decimal(27,0)")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _made(hi: Column, mid: Column, lo: Column) -> Column:
    return F.struct(hi.cast(BIG).alias("hi"), mid.cast("decimal(26,0)").alias("mid"), lo.cast("decimal(26,0)").alias("lo"))


def _carried(hi: Column, mid: Column, lo: Column) -> Column:
    """Limbs of any sign and up to 38 digits as a value."""
    def carry(x: Column, use: Callable[[Column, Column], Column]) -> Column:
        """``use`` of the limb that stays and of what goes up."""
        return _let(x, lambda v: _let(F.pmod(v, _base()), lambda rest: use(rest, ((v - rest) / _base()).cast("decimal(14,0)"))))

    sums = F.struct(hi.cast(BIG).alias("hi"), mid.cast(BIG).alias("mid"), lo.cast(BIG).alias("lo"))
    return _let(sums, lambda s: carry(s["lo"], lambda low, up: carry((s["mid"] + up).cast(BIG), lambda middle, more: _made(s["hi"] + more, middle, low))))


def _complement(v: Column) -> Column:
    """-1 - v: every limb's complement, without a carry."""
    one = F.lit(1).cast("decimal(1,0)")
    return _made(F.lit(-1).cast("decimal(1,0)") - v["hi"], _base() - one - v["mid"], _base() - one - v["lo"])


def wide(word: Column, signed: bool = False) -> Column:
    """A 64-digit hex word as a value; every word is one."""
    def limbs(w: Column) -> Column:
        # values below 2^120, nearly all there are, are two numbers of 60 bits
        low = (F.conv(F.substring(w, 35, 15), 16, 10).cast("decimal(19,0)") * F.lit(2**60).cast("decimal(19,0)") + F.conv(F.substring(w, 50, 15), 16, 10).cast("decimal(19,0)")).cast(BIG)
        return F.when(F.substring(w, 1, 34) == "0" * 34, _let(low, _split)).otherwise(_let(u256(w), lambda x: _made(x["hi"], x["mid"], x["lo"])))

    def value(w: Column) -> Column:
        if not signed:
            return limbs(w)
        return F.when(F.substring(w, 1, 1).isin(*"89abcdef"), _let(limbs(_flipped(w)), _complement)).otherwise(limbs(w))

    return _let(F.lower(word), value)


def _split(x: Column) -> Column:
    """Limbs of a decimal that is not negative."""
    return _let(x % _base(), lambda lo: _made(F.lit(0), ((x - lo) / _base()).cast("decimal(13,0)"), lo))


def wide_lit(n: int) -> Column:
    hi, rest = divmod(n, LIMB * LIMB)
    mid, lo = divmod(rest, LIMB)
    return _made(*(F.lit(str(x)).cast(BIG) for x in (hi, mid, lo)))


def wide_of(v: Column) -> Column:
    """A decimal of up to 38 digits as a value."""
    def value(x: Column) -> Column:
        below = (F.lit(-1).cast("decimal(1,0)") - x).cast(BIG)
        return F.when(x >= 0, _split(x)).when(x < 0, _let(_let(below, _split), _complement))

    return _let(v.cast(BIG), value)


def wide_narrow(v: Column) -> Column:
    """The value as DECIMAL(38,0); null when it has more digits."""
    def joined(x: Column) -> Column:
        small = (x["hi"] == 0) & (x["mid"] < F.lit(10**12).cast("decimal(13,0)"))
        return F.when(small, (x["mid"].cast("decimal(12,0)") * F.lit(str(LIMB)).cast("decimal(27,0)")).cast(BIG) + x["lo"]).cast(BIG)

    def below(down: Column) -> Column:  # -1 - v, which is not negative
        return F.when(down < F.lit("9" * 38).cast(BIG), (F.lit(-1).cast("decimal(1,0)") - down).cast(BIG))

    return _let(v, lambda x: F.when(x["hi"] >= 0, joined(x)).otherwise(_let(_let(_complement(x), joined), below)))


def wide_negative(v: Column) -> Column:
    return v["hi"] < 0


def wide_zero(v: Column) -> Column:
    return (v["hi"] == 0) & (v["mid"] == 0) & (v["lo"] == 0)


def wide_neg(v: Column) -> Column:
    return _let(_let(v, _complement), lambda x: _carried(x["hi"], x["mid"], x["lo"] + F.lit(1).cast("decimal(1,0)")))


def wide_abs(v: Column) -> Column:
    return _let(v, lambda x: F.when(wide_negative(x), wide_neg(x)).otherwise(x))


def wide_add(a: Column, b: Column) -> Column:
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda p: _carried(p["a"]["hi"] + p["b"]["hi"], p["a"]["mid"] + p["b"]["mid"], p["a"]["lo"] + p["b"]["lo"]))


def wide_sub(a: Column, b: Column) -> Column:
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda p: _carried(p["a"]["hi"] - p["b"]["hi"], p["a"]["mid"] - p["b"]["mid"], p["a"]["lo"] - p["b"]["lo"]))


def wide_sum(v: Column) -> Column:
    """Aggregate: the exact sum, null of nothing. A sum of sums is the sum, so partial totals can be stored and merged."""
    hi, mid, lo = (F.sum(v[c].cast(BIG)) for c in ("hi", "mid", "lo"))
    return F.when(lo.isNotNull(), _carried(hi, mid, lo))


def wide_digits(v: Column) -> Column:
    """Decimal digits of a value that is not negative, without leading zeros."""
    def digits(x: Column) -> Column:
        low = F.lpad(x["lo"].cast("string"), 26, "0")
        middle = F.lpad(x["mid"].cast("string"), 26, "0")
        return F.when(x["hi"] != 0, F.concat(x["hi"].cast("string"), middle, low)).when(x["mid"] != 0, F.concat(x["mid"].cast("string"), low)).otherwise(x["lo"].cast("string"))

    return _let(v, digits)


def wide_text(v: Column) -> Column:
    return _let(v, lambda x: F.when(wide_negative(x), F.concat(F.lit("-"), wide_digits(wide_neg(x)))).otherwise(wide_digits(x)))


def wide_parse(digits: Column) -> Column:
    """A value from decimal digits without a sign, at most 90 of them."""
    def split(d: Column) -> Column:
        n = F.length(d)
        return _made(F.substr(d, F.lit(1), n - 52).cast(BIG), F.substr(d, n - 51, F.lit(26)).cast(BIG), F.substr(d, n - 25, F.lit(26)).cast(BIG))

    return _let(F.lpad(digits, F.greatest(F.length(digits), F.lit(53)), "0"), split)


def wide_double(v: Column) -> Column:
    def size(x: Column) -> Column:
        return x["hi"].cast("double") * 1e52 + x["mid"].cast("double") * 1e26 + x["lo"].cast("double")
    # by the magnitude: a small negative value has large limbs that would cancel
    return _let(v, lambda x: F.when(wide_negative(x), F.lit(0.0) - _let(wide_neg(x), size)).otherwise(size(x)))


def wide_key(v: Column) -> Column:
    """Text that sorts as values that are not negative do."""
    return F.concat(F.lpad(v["hi"].cast("string"), 26, "0"), *[F.lpad(v[c].cast("string"), 26, "0") for c in ("mid", "lo")])


def is_wide(df, column: str) -> bool:
    """Whether a frame's column holds limbs rather than a decimal."""
    return df.schema[column].dataType.typeName() == "struct"
