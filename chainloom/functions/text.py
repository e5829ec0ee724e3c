"""Question texts: normalising, wording checks and word filters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NON_ASCII = r"[^\x00-\x7F]"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _nfkc_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def nfkc(text: Column) -> Column:
    """Unicode compatibility form; only texts that are not plain ASCII are sent to Python."""
    odd = text.rlike(NON_ASCII)
    return F.when(odd, _nfkc(F.when(odd, text))).otherwise(text)


def normalize(text: Column) -> Column:
    """What two askings of the same question share."""
    odd = text.rlike(NON_ASCII)
    t = F.when(odd, _nfkc_fold(F.when(odd, text))).otherwise(F.lower(text))
    t = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, r"[?!.？！。]+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), "^ | $", "")


def avoided(text: Column, words: Column) -> Column:
    """Whether a lower-cased text holds any word of an array."""
    low = F.lower(text)
    return F.exists(words, lambda w: F.contains(low, w))


MIN_CHARS, MAX_CHARS = 6, 160

# The patterns of the wording check.
INJECTION = (r"(?iU)(ignore\s+(all\s+)?previous|disregard\s+(the\s+)?above|system\s*:|"
             r"pre-?approved|override|you\s+must\s+(allow|answer)|new\s+instructions)")
FUTURE = (r"(?iU)\b(tomorrow|next (week|month|year)|going to be|predict|"
          r"forecast|will .*\b(be|rise|fall|go|happen|reach|profit))")
OPEN = (r"(?iU)^\s*(what|why|who|when|where|which|how|whose|whom|explain|"
        r"describe|tell|show|list|summari[sz]e|give)\b")
ASKS = (r"(?iU)^\s*(is|are|was|were|does|do|did|has|have|had|can|could|"
        r"should|would|may|might|must|am)\b")


def inspect(text: Column) -> Column:
    """The first reason a question is refused on its words alone, '' when none."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]{2,})"), 1)
    kinds = F.size(F.array_distinct(words))

    def letters(w):
        return F.size(F.array_distinct(F.split(w, "")))
    return (
        F.when(F.length(text) < MIN_CHARS, "short").when(F.length(text) > MAX_CHARS, "long")
        .when(text.rlike(INJECTION), "injection")
        .when((F.size(words) < 2) | ~F.exists(words, lambda w: w.rlike("[aeiouy]")) | F.forall(words, lambda w: letters(w) <= 2), "gibberish")
        .when(text.rlike(FUTURE), "future").when(text.rlike(OPEN), "open")
        .when(~text.endswith("?") & ~text.rlike(ASKS), "statement")
        .when(kinds == 1, "gibberish").otherwise("")
    )


def clean(text: Column) -> Column:
    """Compatibility form without outer white space, as the wording check reads it."""
    return F.regexp_replace(nfkc(text), r"(?U)^\s+|\s+$", "")
