"""Scores: a deterministic stand-in scorer and the rules that settle an answer."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .facts import lookup

PROBS = "array<struct<lane:string,p:double>>"


def hash32(text: Column) -> Column:
    """The first 32 bits of sha1."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("bigint")


def hash_score(text: Column) -> Column:
    """A yes/no score in steps of 1/10000, fixed by the text."""
    return F.pmod(hash32(text), F.lit(10000)) / F.lit(10000.0)


def hash_probs(sentence: Column) -> Column:
    """Ordered lane probabilities of the stand-in scorer."""
    raw = F.transform(
        F.array(*[F.lit(i) for i in range(len(V.LANES))]),
        lambda i: F.pmod(hash32(F.concat(sentence, i.cast("string"))), F.lit(10000)).cast("double"))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    lanes = F.array(*[F.lit(k) for k in V.LANES])
    return F.zip_with(lanes, raw, lambda lane, x: F.struct(lane.alias("lane"), (x / total).alias("p")))


def hash_scorer(sentences: list[str]) -> list[tuple[str, list[float]]]:
    """The same scorer as a plug-in: one (choice, probabilities) per sentence."""
    out = []
    for s in sentences:
        raw = [float(int(hashlib.sha1(f"{s}{i}".encode()).hexdigest()[:8], 16) % 10000) for i in range(len(V.LANES))]
        total = sum(raw)
        probs = [x / total for x in raw]
        out.append((list(V.LANES)[probs.index(max(probs))], probs))
    return out


def _best(probs: Column) -> Column:
    """The entry with the largest probability; the first one wins a tie."""
    return F.aggregate(
        probs, F.try_element_at(probs, F.lit(1)),
        lambda a, x: F.when(x["p"] > a["p"], x).otherwise(a))


def choice_of(probs: Column) -> Column:
    return _best(probs)["lane"]


def settle_lane(choice: Column, probs: Column, ruled: Column, profile: str = "archive") -> Column:
    """struct<lane, p>: a ruled lane stands; a spam answer gives way to its runner-up; a weak one is uncertain."""
    rest = F.filter(probs, lambda x: x["lane"].isin(*[k for k in V.LANES if k != "spam"]))
    spam = choice == "spam"
    top = F.coalesce(F.array_max(F.transform(probs, lambda x: x["p"])), F.lit(0.0))
    lane = F.when(spam, _best(rest)["lane"]).otherwise(choice)
    raw = F.when(spam, _best(rest)["p"]).otherwise(top)
    if profile == "archive":
        p, ruled_p, silent_p = F.floor(raw * 1000 + 0.5) / 1000, F.lit(None).cast("double"), F.lit(None).cast("double")
    else:
        p = F.call_function("format_number", raw, F.lit("0.000")).cast("double")
        ruled_p, silent_p = F.when(ruled == "uncertain", 0.0).otherwise(1.0), F.lit(0.0)

    def out(a, b):
        return F.struct(a.cast("string").alias("lane"), b.cast("double").alias("p"))
    known = lookup(V.LANES, lane).isNotNull()
    return (
        F.when(ruled != "", out(ruled, ruled_p))
        .when(choice.isNull(), out(F.lit("uncertain"), silent_p))
        .when(spam & (F.size(rest) == 0), out(F.lit("uncertain"), F.lit(0.0)))
        .when(~known | (p < V.UNCERTAIN_BELOW), out(F.lit("uncertain"), p))
        .otherwise(out(lane, p))
    )
