"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

E-mail addresses, phone numbers, calendar dates, IPv4 addresses, US social
security numbers, IBANs, Luhn-valid card numbers and long hexadecimal secrets
are found, validated and put through a keyed Feistel network over the values of
their own format. A pseudonym is a valid value of the same kind and length, and
equal values get equal pseudonyms in all documents. What fails its check stays
as it is.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Spark hides settings of this name in its pages and logs.
KEY_SETTING = "spark.chainloom.pii.secret"

#: Fixed patterns, in the order in which they are tried at a place.
EMAIL = r"(?<![A-Za-z0-9._%+-])(?=[._%+-]*+[A-Za-z0-9])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
PHONE = (r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])"
         r"|(?<![0-9A-Za-z+(])\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])"
         r"|(?<![0-9A-Za-z+])(?<![0-9][.-])(?:1[ .-])?(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9A-Za-z]|[.-][0-9])"
         r"|(?<![0-9A-Za-z+])(?<![0-9][ .-])(?:1 )?[0-9]{3} [0-9]{3} [0-9]{4}(?![0-9A-Za-z]|[ .-][0-9])")
DATE = r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
ANY = "|".join([EMAIL, PHONE, DATE, SSN, IP, IBAN, SECRET, CARD])
#: From every place where a card or an IBAN can begin, as far as it can reach and the letter or digit behind it.
CARD_REACH = r"(?<![0-9A-Za-z])(?=([0-9](?:[ -]?[0-9]){12,18}[0-9A-Za-z]?))"
IBAN_REACH = r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}[A-Z0-9 ]{8,44}[a-z]?))"
#: A text with none of these holds no match.
HINT = r"@|[0-9][ .()/-]{0,3}[0-9]|[0-9a-fA-F]{32}"

#: 1900-01-01 to 2099-12-31 are 17 * 4297 days.
FIRST_DAY, DAY_LOW, DAY_HIGH = "1900-01-01", 4297, 17


def feistel(a: Column, b: Column, low: Column, high: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the pairs (a below low, b below high), as a struct.

    The parts take turns being shifted by a keyed hash of the other, so each
    round can be undone. ``tweak`` tells formats apart.
    """
    def shift(part: Column, i: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), part.cast("string")), 256), 1, 14), 16, 10).cast("long")

    def turn(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, F.pmod(state["a"] + F.pmod(shift(state["b"], i), low), low)).otherwise(state["a"]).alias("a"),
                        F.when(even, state["b"]).otherwise(F.pmod(state["b"] + F.pmod(shift(state["a"], i), high), high)).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def once(value: Column, body) -> Column:
    """``body`` of the value, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _pieces(text: Column, size: int) -> Column:
    """The text cut every ``size`` characters."""
    return F.filter(F.split(text, rf"(?<=\G[\s\S]{{{size}}})"), lambda p: p != "")


def permuted(chars: Column, base: int, key: str, kind: str) -> Column:
    """A string of base-10, -16 or -36 digits put through the network in pieces; a piece also depends on the eight before it."""
    piece = {10: 18, 16: 14, 36: 10}[base]

    def one(text: Column, i: Column, s: Column) -> Column:
        half = F.ceil(F.length(text) / 2).cast("int")
        left, right = F.substr(text, F.lit(1), half), F.substr(text, half + 1)
        number = lambda s: F.coalesce(F.conv(F.when(s == "", "0").otherwise(s), base, 10).cast("long"), F.lit(0).cast("long"))
        size = lambda n: F.round(F.pow(F.lit(float(base)), n)).cast("long")
        rest = F.length(text) - half
        before = F.array_join(F.slice(s["pieces"], F.greatest(F.lit(1), i - 7), F.least(i, F.lit(8))), "")
        tweak = F.concat_ws("|", F.lit(kind), s["size"].cast("string"), i.cast("string"), before)
        return once(feistel(number(left), number(right), size(half), size(rest), key, tweak),
                    lambda s: F.concat(F.lpad(F.lower(F.conv(s["a"].cast("string"), 10, base)), half, "0"),
                                       F.when(rest > 0, F.lpad(F.lower(F.conv(s["b"].cast("string"), 10, base)), rest, "0")).otherwise("")))

    cut = once(chars, lambda c: F.struct(F.length(c).alias("size"), _pieces(c, piece).alias("pieces")))
    return once(cut, lambda s: F.array_join(F.transform(s["pieces"], lambda p, i: one(p, i, s)), ""))


def refilled(text: Column, other: str, chars: Column) -> Column:
    """The text with its characters outside the class ``other`` replaced by ``chars`` in turn; upper case stays upper case."""
    def part(s: Column) -> Column:
        def one(old: Column, i: Column) -> Column:
            new = F.substr(s["fill"], F.length(F.regexp_replace(F.substr(s["part"], F.lit(1), i + 1), other, "")), F.lit(1))
            return F.when(old.rlike(other), old).when(old.rlike("[A-Z]"), F.upper(new)).otherwise(new)

        return F.array_join(F.transform(F.split(s["part"], ""), one), "")

    def parts(s: Column) -> Column:
        # how many characters are taken before each part of 64
        taken = F.aggregate(s["parts"], F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(F.regexp_replace(p, other, "")))))
        filled = lambda t: F.transform(s["parts"], lambda p, k: once(
            F.struct(p.alias("part"), F.substr(s["chars"], F.get(t, k) + 1, F.lit(64)).alias("fill")), part))
        return F.array_join(once(taken, filled), "")

    return once(F.struct(_pieces(text, 64).alias("parts"), chars.alias("chars")), parts)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum from the right; ``doubled`` is 1 if the last digit is doubled."""
    def one(i: Column) -> Column:
        d = F.substr(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((i + doubled) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), one), F.lit(0), lambda s, x: s + x)


def _valid(text: Column, reach: str, shape: str, least: int, most: int, check) -> Column:
    """The values of a shape that pass their check, of every start and length that no letter or digit touches."""
    def starts(w: Column) -> Column:
        def one(n: Column) -> Column:
            m = F.substr(w, F.lit(1), n)
            fits = (n <= F.length(w)) & ~F.substr(w, n + 1, F.lit(1)).rlike("[0-9A-Za-z]") & m.rlike(f"^(?:{shape})$")
            return F.when(fits, F.when(check(m), m))

        return F.filter(F.transform(F.sequence(F.lit(least), F.lit(most)), one), lambda m: m.isNotNull())

    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(reach), F.lit(1)), starts)))


def _pattern(text: Column) -> Column:
    """ANY for one text, with its valid cards and IBANs, longer ones first, in place of all that look like some."""
    cards = _valid(text, CARD_REACH, r"[0-9](?:[ -]?[0-9]){12,18}", 13, 37, lambda m: luhn_sum(_digits(m), 0) % 10 == 0)
    ibans = _valid(text, IBAN_REACH, r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", 12, 43, _iban_holds)
    found = F.array_sort(F.concat(cards, ibans), lambda a, b: F.length(b) - F.length(a))
    values = F.when(F.size(found) > 0, F.concat(F.lit("|(?<![0-9A-Za-z])(?:"), F.array_join(found, "|"), F.lit(")(?![0-9A-Za-z])"))).otherwise("")
    return F.concat(F.lit("|".join([EMAIL, PHONE, DATE, SSN, IP])), values, F.lit("|" + SECRET))


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = permuted(F.substr(digits, F.lit(1), F.length(digits) - 1), 10, key, "card")
    whole = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(F.lit(10) - luhn_sum(b, 1) % 10, F.lit(10)).cast("string")))[0]
    return F.when(luhn_sum(digits, 0) % 10 == 0, refilled(m, "[^0-9]", whole)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """The country code stays, the number behind it is permuted."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[^0-9])|^\+[0-9]{2}|^1[ .-]|^", 0)
    rest = F.substr(m, F.length(code) + 1)
    return F.concat(code, refilled(rest, "[^0-9]", permuted(_digits(rest), 10, key, "phone")))


def _ip(m: Column, key: str) -> Column:
    part = F.split(m, r"\.")
    n = [F.try_element_at(part, F.lit(i)).cast("int") for i in (1, 2, 3, 4)]
    new = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    text = F.transform(F.array(new), lambda s: F.concat_ws(".", *[x.cast("int").cast("string") for v in (s["a"], s["b"]) for x in (F.floor(v / 256), v % 256)]))[0]
    return F.when((n[0] < 256) & (n[1] < 256) & (n[2] < 256) & (n[3] < 256), text).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = F.substr(m, F.lit(1), F.lit(3)).cast("int"), F.substr(m, F.lit(5), F.lit(2)).cast("int"), F.substr(m, F.lit(8), F.lit(4)).cast("int")
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    new = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"))

    def spell(s: Column) -> Column:
        p = F.floor(s["a"] / 99)
        return F.concat_ws("-", F.lpad(F.when(p >= 665, p + 2).otherwise(p + 1).cast("string"), 3, "0"), F.lpad((s["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["b"] + 1).cast("string"), 4, "0"))

    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), F.transform(F.array(new), spell)[0]).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """Any day of 1900 to 2099 in its own notation; xx/yy/zzzz is day first if that is a day, else month first."""
    def spelled(form: str):
        return lambda s: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (s["b"] * DAY_LOW + s["a"]).cast("int")), form)

    out = m
    for form in ["MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy-MM-dd"]:  # the last that fits counts
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        index = F.datediff(day, F.lit(FIRST_DAY))
        new = feistel(index % DAY_LOW, F.floor(index / DAY_LOW), F.lit(DAY_LOW), F.lit(DAY_HIGH), key, F.lit("date"))
        text = F.transform(F.array(new), spelled(form))[0]
        out = F.when(day.isNotNull(), text).otherwise(out)
    return out


def _iban_remainder(country: Column, check: Column, rest: Column) -> Column:
    chars = F.split(F.concat(rest, country, check), "")
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), lambda s, c: (s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _iban_parts(m: Column) -> tuple[Column, Column, Column]:
    plain = F.regexp_replace(m, " ", "")
    return F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(3), F.lit(2)), F.substr(plain, F.lit(5))


def _iban_holds(m: Column) -> Column:
    return _iban_remainder(*_iban_parts(m)) == 1


def _iban(m: Column, key: str) -> Column:
    """Country and letters stay, digits are permuted and the check digits made new (remainder 1 by 97)."""
    country, check, rest = _iban_parts(m)
    fresh = F.when(_digits(rest) == "", rest).otherwise(refilled(rest, "[^0-9]", permuted(_digits(rest), 10, key, "iban")))
    whole = F.transform(F.array(fresh), lambda r: F.concat(country, F.lpad((F.lit(98) - _iban_remainder(country, F.lit("00"), r)).cast("string"), 2, "0"), r))[0]
    return F.when(_iban_remainder(country, check, rest) == 1, refilled(m, "[ ]", whole)).otherwise(m)


def _email(m: Column, key: str) -> Column:
    """Letters and digits before the @ are permuted as base-36 digits, upper case as lower; the domain stays."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    chars = F.lower(F.regexp_replace(local, "[^A-Za-z0-9]", ""))
    return F.concat(refilled(local, "[^A-Za-z0-9]", permuted(chars, 36, key, "email")), F.lit("@"), domain)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of ANY."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(m, F.lit("@")), _email(m, key))
        .when(whole(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), _ip(m, key))
        .when(whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), _ssn(m, key))
        .when(whole(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}"), _date(m, key))
        .when(m.rlike(r"^[+(]") | whole(r"(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"), _phone(m, key))
        .when(whole("[0-9a-fA-F]{32,64}"), refilled(m, "[^0-9A-Fa-f]", permuted(F.lower(m), 16, key, "secret")))
        .when(m.rlike("^[A-Z]{2}[0-9]{2}"), _iban(m, key))
        .otherwise(_card(m, key))
    )


def session_key(spark: SparkSession) -> str:
    """The key that the setting ``KEY_SETTING`` names; a session without one draws its own and keeps it.

    With a drawn key equal values are linked within the session, and nobody can
    undo them later. Jobs whose pseudonyms must agree set the same key.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymized(docs: DataFrame, key: str | None = None) -> DataFrame:
    """Every row with its personal data replaced: doc (the input row), doc_id, text and n_replaced (values that changed).

    ``key`` decides the pseudonyms (default: ``session_key``); who keeps it
    secret can link but not undo them for others. A null text stays null and an
    empty one empty, with nothing replaced; equal rows are replaced alike, and
    values of any length take time in proportion to it.
    """
    key = session_key(docs.sparkSession) if key is None else key
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.col("doc.text")
    packed = packed.withColumn("pattern", F.when(text.rlike(HINT), _pattern(text)))
    found = packed.withColumn("found", F.regexp_extract_all(text, F.col("pattern"), F.lit(0)))
    named = found.withColumn("named", F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(m, key))))
    between = F.split(text, F.col("pattern"), -1)
    joined = F.array_join(F.zip_with(between, F.col("named"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.coalesce(F.size(F.filter(F.zip_with("found", "named", lambda a, b: a != b), lambda x: x)), F.lit(0))
    return named.select(
        "doc", F.col("doc.doc_id").alias("doc_id"), F.when(F.col("named").isNull(), text).otherwise(joined).alias("text"),
        F.when(F.col("named").isNull(), F.lit(0)).otherwise(changed).cast("long").alias("n_replaced"))
