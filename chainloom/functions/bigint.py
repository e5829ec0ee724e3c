"""256-bit integers from 32-byte words, exact, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIG = "decimal(38,0)"


def negated(v: Column) -> Column:
    """0 - v. Unary minus (and abs, which uses it) keeps only 34 digits of a decimal; subtraction keeps all 38."""
    return (F.lit(0).cast("decimal(1,0)") - v).cast(BIG)


def magnitude(v: Column) -> Column:
    return F.when(v < 0, negated(v)).otherwise(v)


def _limb(word: Column, start: int) -> Column:
    return F.conv(F.substring(word, start, 8), 16, 10).cast("decimal(10,0)")


#: 10^38 and the largest flipped word of a negative number that 38 digits hold, as 32 hex digits.
TOO_BIG = f"{10**38:032x}"
TOO_SMALL = f"{10**38 - 1:032x}"


def _flipped(word: Column) -> Column:
    return F.translate(F.lower(word), "0123456789abcdef", "fedcba9876543210")


def fits_decimal(word: Column, signed: bool = False) -> Column:
    """Whether a 64-digit word is an integer of at most 38 digits."""
    def low_enough(x: Column, limit: str) -> Column:
        return (F.substring(x, 1, 32) == "0" * 32) & (F.substring(x, 33, 32) < limit)

    plain = low_enough(F.lower(word), TOO_BIG)
    if not signed:
        return plain
    return F.when(F.lower(F.substring(word, 1, 1)).isin(*"89abcdef"), low_enough(_flipped(word), TOO_SMALL)).otherwise(plain)


def word_to_decimal(word: Column, signed: bool = False) -> Column:
    """A 64-digit word as DECIMAL(38,0); null when the value has more than 38 digits (see ``fits_decimal``)."""
    low = F.substring(word, 33, 32)
    two32 = F.lit(2**32).cast("decimal(10,0)")

    def value(text: Column) -> Column:
        acc = _limb(text, 1).cast(BIG)
        for at in (9, 17, 25):
            acc = (acc * two32 + _limb(text, at)).cast(BIG)
        return acc

    # values below 2^120, nearly all there are, take two conversions
    pair = (F.conv(F.substring(word, 35, 15), 16, 10).cast("decimal(19,0)") * F.lit(2**60).cast("decimal(19,0)")
            + F.conv(F.substring(word, 50, 15), 16, 10).cast("decimal(19,0)")).cast(BIG)
    plain = F.when(F.substring(word, 1, 34) == "0" * 34, pair).when(fits_decimal(word), value(low))
    if not signed:
        return plain
    negative = F.when(fits_decimal(word, True), (negated(value(_flipped(low))) - F.lit(1).cast("decimal(1,0)")).cast(BIG))
    return F.when(F.lower(F.substring(word, 1, 1)).isin(*"89abcdef"), negative).otherwise(plain)


LIMB = 10**26


def u256(word: Column) -> Column:
    """An unsigned word as three base-10^26 limbs (hi, mid, lo): any 78-digit value, exactly.

    A word that fits 38 digits is cut from its decimal. Else digits are fed in from the top, eight hex digits (32 bits) at a time:
    value = value * 2^32 + next, with the carry passed up between limbs.
    """
    base = F.lit(str(LIMB)).cast("decimal(27,0)")
    two32 = F.lit(2**32).cast("decimal(10,0)")
    word = F.lower(word)

    def carry(v: Column) -> Column:
        return ((v - v % base) / base).cast("decimal(12,0)")

    def step(acc: Column, at: Column) -> Column:
        lo = (acc["lo"] * two32).cast(BIG) + F.conv(F.substr(word, at, F.lit(8)), 16, 10).cast("decimal(10,0)")
        lo = lo.cast(BIG)
        mid = ((acc["mid"] * two32).cast(BIG) + carry(lo)).cast(BIG)
        hi = ((acc["hi"] * two32).cast(BIG) + carry(mid)).cast(BIG)
        return F.struct(hi.cast("decimal(26,0)").alias("hi"), (mid % base).cast("decimal(26,0)").alias("mid"),
                        (lo % base).cast("decimal(26,0)").alias("lo"))

    zero = F.lit(0).cast("decimal(26,0)")
    start = F.struct(zero.alias("hi"), zero.alias("mid"), zero.alias("lo"))
    at = F.array(*[F.lit(i) for i in range(1, 64, 8)])
    small = F.substring(word, 1, 34) == "0" * 34
    return F.when(small, decimal_to_limbs(word_to_decimal(word))).otherwise(F.aggregate(at, start, step))


def decimal_to_limbs(v: Column) -> Column:
    base = F.lit(str(LIMB)).cast("decimal(27,0)")
    v = v.cast(BIG)
    lo = (v % base).cast("decimal(26,0)")
    return F.struct(F.lit(0).cast("decimal(26,0)").alias("hi"),
                    ((v - lo) / base).cast("decimal(26,0)").alias("mid"), lo.alias("lo"))


def u256_text(v: Column) -> Column:
    """The decimal digits of a limb value, without leading zeros."""
    digits = F.concat(*[F.lpad(v[c].cast("string"), 26, "0") for c in ("hi", "mid", "lo")])
    return F.regexp_replace(digits, "^0+(?=.)", "")


def u256_key(v: Column) -> Column:
    """Text that sorts as the value does."""
    return F.concat(*[F.lpad(v[c].cast("string"), 26, "0") for c in ("hi", "mid", "lo")])


def u256_sum(v: Column) -> Column:
    """Exact sum as digits: limbs are summed apart (10^12 rows fit in 38 digits) and carried once at the end."""
    base = F.lit(str(LIMB)).cast("decimal(27,0)")
    hi, mid, lo = (F.sum(v[c].cast(BIG)) for c in ("hi", "mid", "lo"))

    def up(x: Column) -> Column:
        return ((x - x % base) / base).cast("decimal(13,0)")

    lo = lo.cast(BIG)
    mid = (mid + up(lo)).cast(BIG)
    hi = (hi + up(mid)).cast(BIG)
    return F.regexp_replace(
        F.concat(hi.cast("string"), F.lpad((mid % base).cast(BIG).cast("string"), 26, "0"),
                 F.lpad((lo % base).cast(BIG).cast("string"), 26, "0")), "^0+(?=.)", "")
