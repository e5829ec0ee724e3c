"""Amounts: buckets, words and exact formatting. No amount passes through a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .facts import lookup
from .wide import wide_add, wide_digits, wide_of, wide_parse

BIG = "decimal(38,0)"
MINUS = "−"
DOTS = "…"


def _below_power(value: Column, power: Column) -> Column:
    """value < 10^power for a positive integer value of up to 38 digits."""
    powers = F.expr("array(" + ", ".join(f"cast('{10**k}' as {BIG})" for k in range(38)) + ")")
    return F.when(power < 0, False).when(power > 37, True).otherwise(
        value < F.get(powers, F.greatest(F.least(power, F.lit(37)), F.lit(0)).cast("int")))


def amount_bucket(value: Column, label: Column, decimals: Column) -> Column:
    """The bucket of a raw amount; integer comparisons only. Unknown decimals leave 'a nonzero amount'."""
    def say(prefix):
        return F.concat(F.lit(prefix), label)
    return (
        F.when(value == 0, say("zero "))
        .when(decimals.isNull(), say("a nonzero amount of "))
        .when(_below_power(value, decimals - 2), say("less than one cent of "))
        .when(_below_power(value, decimals), say("under 1 "))
        .when(_below_power(value, decimals + 2), say("1 to 100 "))
        .when(_below_power(value, decimals + 4), say("100 to 10,000 "))
        .otherwise(say("over 10,000 "))
    )


def amount_words(value: Column) -> Column:
    """The live bucket with its size in words beside it."""
    bucket = amount_bucket(value, F.lit("USDC"), F.lit(V.LIVE_DECIMALS))
    size = lookup(V.SIZE_WORDS, bucket)
    return F.when(size.isNull(), bucket).otherwise(F.concat(bucket, F.lit(" ("), size, F.lit(")")))


def units_to_decimal(value: Column, decimals: Column | int) -> Column:
    """Raw units as an exact decimal string without trailing zeros."""
    digits = F.regexp_replace(value.cast("string"), "^-", "")
    return F.concat(F.when(value < 0, "-").otherwise(""), digits_to_decimal(digits, decimals))


def digits_to_decimal(digits: Column, decimals: Column | int) -> Column:
    """``units_to_decimal`` of the digits of a number that is not negative, however many."""
    d = F.lit(decimals) if isinstance(decimals, int) else decimals
    wide = F.lpad(digits, F.greatest(F.length(digits), d + 1), "0")
    whole = F.substr(wide, F.lit(1), F.length(wide) - d)
    rest = F.regexp_replace(F.substr(wide, F.length(wide) - d + 1, d), "0+$", "")
    return F.concat(whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))


def group_digits(digits: Column) -> Column:
    return F.regexp_replace(digits, r"\B(?=(\d{3})+(?!\d))", ",")


def _scaled(dec: Column, places: int, limbs: bool = False):
    """(negative, the digits of |value| * 10^places rounded half up, nonzero) of a decimal string; ``limbs`` for more than 38 digits."""
    body = F.regexp_replace(dec, "^-", "")
    whole, rest = F.split_part(body, F.lit("."), F.lit(1)), F.split_part(body, F.lit("."), F.lit(2))
    padded = F.rpad(rest, places + 1, "0") if places + 1 else rest
    kept = F.concat(whole, F.substring(padded, 1, places))
    up = F.when(F.substring(padded, places + 1, 1) >= "5", 1).otherwise(0).cast("decimal(1,0)")
    digits = wide_digits(wide_add(wide_parse(kept), wide_of(up))) if limbs else (kept.cast(BIG) + up).cast(BIG).cast("string")
    nonzero = body.rlike("[1-9]")
    return dec.startswith("-") & nonzero, digits, nonzero


def fmt_amount(dec: Column, limbs: bool = False) -> Column:
    """Two decimals with separators; '<0.01' for a nonzero amount that rounds to nothing."""
    neg, cents, nonzero = _scaled(dec, 2, limbs)
    digits = F.lpad(cents, F.greatest(F.length(cents), F.lit(3)), "0")
    whole = group_digits(F.substr(digits, F.lit(1), F.length(digits) - 2))
    shown = F.concat(whole, F.lit("."), F.substring(digits, -2, 2))
    sign = F.when(neg, MINUS).otherwise("")
    return F.when((cents == "0") & nonzero, F.concat(sign, F.lit("<0.01"))).when(cents == "0", "0.00").otherwise(F.concat(sign, shown))


def fmt_whole(dec: Column) -> Column:
    neg, units, _ = _scaled(dec, 0)
    return F.concat(F.when(neg & (units != "0"), MINUS).otherwise(""), group_digits(units))


def fmt_signed(dec: Column) -> Column:
    neg, _, nonzero = _scaled(dec, 2)
    return F.when(~nonzero, "0.00").when(neg, fmt_amount(dec)).otherwise(F.concat(F.lit("+"), fmt_amount(dec)))


def fmt_int(value: Column) -> Column:
    s = value.cast("string")
    return F.when(s.startswith("-"), F.concat(F.lit(MINUS), group_digits(F.substring(s, 2, 80)))).otherwise(group_digits(s))


def fmt_fee(fee: Column) -> Column:
    """Hundredths of a basis point as a percentage; rounded as the binary quotient is, ties away from zero."""
    tie = (fee % 1250 == 0) & (fee % 100 == 50)
    even = F.call_function("format_number", (fee / F.lit(10000.0)).cast("double"), F.lit("0.00"))
    up = ((fee + 50).cast("decimal(20,0)") / 10000).cast("decimal(20,2)").cast("string")
    return F.concat(F.when(tie, up).otherwise(even), F.lit("%"))


def pct(part: Column, total: Column) -> Column:
    """Whole percent, half up; 0 of nothing."""
    return F.when(total > 0, F.floor((200 * part + total) / (2 * total))).otherwise(0).cast("bigint")


def short_address(a: Column) -> Column:
    return F.concat(F.substring(a, 1, 6), F.lit(DOTS), F.substring(a, -4, 4))


def short_hash(h: Column) -> Column:
    return F.concat(F.substring(h, 1, 10), F.lit(DOTS), F.substring(h, -6, 6))


def _hex(s: Column, digits: int) -> Column:
    v = F.lower(F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.when(v.rlike(f"^0x[0-9a-f]{{{digits}}}$"), v)


def parse_hash(s: Column) -> Column:
    return _hex(s, 64)


def parse_address(s: Column) -> Column:
    return _hex(s, 40)


def parse_before(s: Column) -> Column:
    """A paging token ``<block>-<log>`` as a struct, else null."""
    pattern = r"^(\d{1,15})-(\d{1,9})$"
    return F.when(s.rlike(pattern), F.struct(F.regexp_extract(s, pattern, 1).try_cast("bigint").alias("block"),
                                             F.regexp_extract(s, pattern, 2).try_cast("int").alias("li")))
