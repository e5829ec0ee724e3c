"""What a transaction's selector and topics say, as column expressions that never shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(items) -> Column:
    """A fixed list as a literal array (one expression text, however long the list)."""
    return F.expr(f"array({', '.join(_sql(i) for i in items)})") if items else F.array().cast("array<string>")


def lookup(table: dict[str, str], key: Column) -> Column:
    """A fixed table as a literal map; null for a key it lacks."""
    entries = ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({entries})"), key)


def facts(selector: Column, topics: Column) -> Column:
    """The facts found, in reading order; empty for an unread transaction."""
    found = F.concat(F.array(lookup(V.FACT_BY_SELECTOR, selector)),
                     F.transform(topics, lambda t: lookup(V.FACT_BY_TOPIC, t)))
    out = F.filter(texts(V.FACT_ORDER), lambda f: F.array_contains(found, f))
    return F.when(topics.isNull(), F.array().cast("array<string>")).otherwise(out)


def protocol(ctx: Column, profile: str = "archive") -> Column:
    """Who handled the transaction: first matching rule, else the venue; '' when unknown.

    The live profile also says USDC for a direct call of the token or plain value.
    """
    marks = F.concat(F.array(ctx["selector"]), ctx["topics"])
    rules = [F.when(F.arrays_overlap(marks, texts([*sels, *tops])), F.lit(name)) for name, sels, tops in V.PROTOCOL_RULES]
    at_venue = ctx["to"].isin(V.VENUE_ENTRY_POINTS) | F.array_contains(ctx["emitters"], V.POOL_MANAGER)
    deployed = F.filter(F.transform(F.map_values(ctx["factories"]), lambda f: lookup(V.FACTORY_NAMES, f)), lambda n: n.isNotNull())
    venue = F.when(at_venue, "Uniswap").otherwise(F.try_element_at(deployed, F.lit(1)))
    tail = []
    if profile == "live":
        tail = [F.when((ctx["to"] == V.USDC) | (ctx["selector"] == "0x"), "USDC")]
    return F.coalesce(*rules, venue, *tail, F.lit(""))


def bridge_direction(selector: Column, topics: Column) -> Column:
    """'out', 'in', or '' when the transaction says neither or both."""
    marks = F.concat(F.array(selector), topics)
    out, into = F.arrays_overlap(marks, texts(V.BRIDGE_OUT)), F.arrays_overlap(marks, texts(V.BRIDGE_IN))
    return F.when(out & ~into, "out").when(into & ~out, "in").otherwise("")


def is_plain(ctx: Column, found: Column, contract: Column) -> Column:
    """No facts, a plain selector, and the token itself called or no input at all."""
    direct = (ctx["to"] == contract) | (ctx["selector"] == "0x")
    return F.coalesce(ctx.isNotNull() & (F.size(found) == 0) & ctx["selector"].isin(V.PLAIN_SELECTORS) & direct, F.lit(False))


def call_phrase(ctx: Column, fn: Column) -> Column:
    """The called function's name, left out where the sentence already says what happened."""
    said = ctx["selector"].isin([*V.FACT_BY_SELECTOR, *V.PLAIN_SELECTORS])
    return F.when(ctx.isNotNull() & fn.isNotNull() & (fn != "") & ~said,
                  F.concat(F.lit("It was called with "), fn, F.lit("."))).otherwise("")


def fact_lane(found: Column, plain: Column) -> Column:
    """The lane the facts place a transfer in; payment when plain; null when nothing places it."""
    placed = [F.when(F.array_contains(found, f), F.lit(lane)) for f, lane in V.FACT_LANES]
    return F.coalesce(*placed, F.when(plain, "payment"))


def lane_why(lane: Column, ruled: Column, scorer: str = "The scorer") -> Column:
    """Why a row has its lane, for ruled, uncertain and chosen lanes."""
    text = lookup(V.LANES, lane)
    chosen = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1000), F.lit("."))
    return (
        F.when(ruled, F.coalesce(lookup(V.RULED_WHY, lane), F.lit("Ruled by the transaction itself.")))
        .when(lane == "uncertain", f"{scorer} was not sure enough to file it (below {V.UNCERTAIN_BELOW}).")
        .otherwise(F.coalesce(chosen, F.lit(f"{scorer} filed it under this lane.")))
    )


def known_name(address: Column) -> Column:
    return lookup(V.KNOWN_NAMES, F.lower(address))
