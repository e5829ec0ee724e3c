"""Contexts, parties, tokens and the address dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from .ranking import global_rank, row_number_by_log

BIG = "decimal(38,0)"


def native_to_6(value: Column) -> Column:
    """18 decimals to 6, rounded up, exactly (no fractional division is ever rounded)."""
    m = F.lit(10 ** (V.NATIVE_DECIMALS - V.LIVE_DECIMALS)).cast("decimal(13,0)")
    rest = value % m
    return ((value - rest) / m).cast(BIG) + F.when(rest > 0, 1).otherwise(0).cast("decimal(1,0)")


def drop_mirrors(logs: DataFrame, native: DataFrame, scale: int = 10**12) -> DataFrame:
    """The native logs that remain after each ERC-20 log has cancelled one equal native log.

    A multiset difference that keeps whole rows: equal ERC-20 logs are only
    counted, and a native log survives when its number within its key is beyond
    that count. Native logs are read for their numbers and for the sizes of
    their pieces, so they are written once.
    """
    keys = ["tx_hash", "from_addr", "to_addr", "value"]
    transfer = F.struct("from_addr", "to_addr", F.col("value").cast(BIG).alias("value"))
    taken = (
        logs.select(*keys).dropna().repartition("tx_hash").withColumn("value", (F.col("value") * F.lit(scale).cast("decimal(13,0)")).cast(BIG))
        .groupBy(*keys).agg(F.count("*").alias("_n")).groupBy("tx_hash")
        .agg(F.map_from_entries(F.collect_list(F.struct(transfer.alias("transfer"), "_n"))).alias("_taken"))
    )
    return (
        row_number_by_log(native, keys, "_rn").join(taken, "tx_hash", "left")
        .filter(F.col("_rn") > F.coalesce(F.try_element_at("_taken", transfer), F.lit(0))).drop("_rn", "_taken")
    )


def drop_gas_refunds(transfers: DataFrame, ctx: DataFrame, entrypoints: list[str] = V.ENTRYPOINTS) -> DataFrame:
    """Drop what an EntryPoint pays back to the transaction's own sender.

    Only transfers from an EntryPoint need their context, so only those are joined.
    """
    sender = ctx.filter("ctx IS NOT NULL").select("tx_hash", F.col("ctx.sender").alias("to_addr"))
    suspects = transfers.filter(F.col("from_addr").isin(entrypoints))
    rest = transfers.filter(~F.col("from_addr").isin(entrypoints))
    return rest.unionByName(suspects.join(sender, ["tx_hash", "to_addr"], "left_anti"))


CTX_FIELDS = ["to", "selector", "topics", "sender", "emitters", "factories", "value_sent"]


def tx_context(txs: DataFrame, receipt_logs: DataFrame) -> DataFrame:
    """(tx_hash, block_number, ctx) from transactions and their receipts' logs, in log order.

    A receipt's logs are bounded by the block's gas limit, so the per-transaction
    lists are too. Transactions that were not found have a null context.
    """
    logs = receipt_logs.filter(F.col("topic0").isNotNull()).groupBy("tx_hash").agg(
        F.array_sort(F.collect_list(F.struct("log_index", "topic0", "emitter"))).alias("_logs"))
    none = F.array().cast("array<struct<log_index:int,topic0:string,emitter:string>>")
    x = txs.join(logs, "tx_hash", "left").withColumn("_logs", F.coalesce("_logs", none))
    long_enough = F.length("input") >= 10
    ctx = F.struct(
        F.lower("to").alias("to"),
        F.when(long_enough, F.lower(F.substring("input", 1, 10))).otherwise("0x").alias("selector"),
        F.transform("_logs", lambda g: F.lower(g["topic0"])).alias("topics"),
        F.lower("sender").alias("sender"),
        F.transform("_logs", lambda g: F.lower(F.coalesce(g["emitter"], F.lit("")))).alias("emitters"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("factories"),
        F.col("value_sent"),
    )
    return x.select("tx_hash", "block_number", F.when(F.col("found"), ctx).alias("ctx"))


def tx_pools(ctx: DataFrame, pool_topics: list[str] = V.POOL_TOPICS) -> DataFrame:
    """Distinct (tx_hash, pool): emitters of a pool event. Duplicates leave inside the row, before any shuffle."""
    pairs = F.arrays_zip(F.col("ctx.topics").alias("t"), F.col("ctx.emitters").alias("e"))
    hits = F.filter(pairs, lambda p: p["t"].isin(*pool_topics) & (p["e"] != ""))
    pools = F.array_distinct(F.transform(hits, lambda p: p["e"]))
    return ctx.filter("ctx IS NOT NULL").select("tx_hash", F.explode(pools).alias("pool"))


def with_factories(ctx: DataFrame, factories: DataFrame, pool_topics: list[str] = V.POOL_TOPICS) -> DataFrame:
    """Fill each context's pool -> factory map; pools nobody could name are left out."""
    known = (
        tx_pools(ctx, pool_topics).join(factories, "pool").groupBy("tx_hash")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pool", "factory")))).alias("_f"))
    )
    fields = [F.coalesce("_f", "ctx.factories").alias(c) if c == "factories" else F.col(f"ctx.{c}").alias(c) for c in CTX_FIELDS]
    return ctx.join(known, "tx_hash", "left").withColumn(
        "ctx", F.when(F.col("ctx").isNotNull(), F.struct(*fields))).drop("_f")


def is_contract_code(code: Column) -> Column:
    """Empty code is a wallet, and so is a 23-byte delegation (0xef0100 and an address)."""
    delegated = F.lower(code).startswith("0xef0100") & (F.length(code) == 48)
    return ~(code.isin("", "0x", "0x0") | delegated)


def party_kinds(transfers: DataFrame, ctx: DataFrame, codes: DataFrame) -> DataFrame:
    """(address, is_contract) of all parties but the zero address; null when nobody answered."""
    parties = (
        transfers.select(F.explode(F.array("from_addr", "to_addr")).alias("address"))
        .filter(F.col("address") != V.ZERO_ADDRESS).distinct()
    )
    senders = ctx.filter("ctx IS NOT NULL").select(F.col("ctx.sender").alias("address")).distinct().withColumn("_sent", F.lit(True))
    return (
        parties.join(senders, "address", "left").join(codes, "address", "left")
        .select("address", F.when(F.col("_sent"), F.lit(False)).otherwise(is_contract_code(F.col("code"))).alias("is_contract"))
    )


def known_kinds(ctx: DataFrame, codes: DataFrame) -> DataFrame:
    """(address, is_contract) of every address with code or that ever sent a transaction: the dimension itself.

    For jobs that describe whole ranges: it spares a pass over the transfers to
    find which addresses to ask about.
    """
    senders = ctx.filter("ctx IS NOT NULL").select(F.col("ctx.sender").alias("address"), F.lit(False).alias("is_contract"))
    coded = codes.select("address", is_contract_code(F.col("code")).alias("is_contract"))
    # a sender is a wallet whatever its code says, so false wins
    return senders.unionByName(coded).filter(F.col("address") != V.ZERO_ADDRESS).groupBy("address").agg(
        F.bool_and("is_contract").alias("is_contract"))


SYMBOL = r"^[A-Za-z0-9$._-]{1,16}$"


def token_dim(events: DataFrame, known: DataFrame, reads: DataFrame) -> DataFrame:
    """label and decimals per contract: built-in rows, else what was read, else the contract's name."""
    k = known.select("address", F.col("label").alias("_kl"), F.col("decimals").alias("_kd"))
    r = reads.select("address", F.trim("symbol").alias("_sym"), F.col("decimals").alias("_rd"))
    label = F.when(F.col("_kl").isNotNull(), F.col("_kl")).when(F.col("_sym").rlike(SYMBOL), F.col("_sym")).otherwise(F.col("contract"))
    decimals = F.when(F.col("_kl").isNotNull(), F.col("_kd")).otherwise(F.col("_rd"))
    return events.select("address", "contract").distinct().join(k, "address", "left").join(r, "address", "left").select(
        "address", label.alias("label"), decimals.alias("decimals"))


def page_symbol(symbol: Column) -> Column:
    """Printable ASCII only, trimmed, at most 16 characters; null when nothing is left."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(symbol, r"[^\x20-\x7e]", "")), 1, 16), F.lit(""))


def token_meta(reads: DataFrame) -> DataFrame:
    """The page's token table: its own symbol rule, and decimals only up to 77."""
    return reads.select("address", page_symbol(F.col("symbol")).alias("symbol"),
                        F.when(F.col("decimals") <= 77, F.col("decimals")).alias("decimals"))


def assign_ids(dictionary: DataFrame, values: DataFrame, columns: list[str], last: Column | None = None, few: bool = False) -> DataFrame:
    """New dictionary rows (id, address): dense ids after the largest known one, in order of first sight.

    ``values`` also carries block_number and log_index. Known addresses consume
    no id. ``last`` is the largest id where ``dictionary`` is only a part of the whole.
    ``few`` says that the caller counted the values and one task may number them.
    """
    seen = (
        values.select("block_number", "log_index", F.explode(F.array(*columns)).alias("address"))
        .filter("address IS NOT NULL")
        .groupBy("address").agg(F.min(F.struct("block_number", "log_index")).alias("_first"))
    )
    new = seen.join(dictionary.select("address"), "address", "left_anti")
    placed, order = new.select("address", F.col("_first.block_number").alias("b"), F.col("_first.log_index").alias("l")), ["b", "l", "address"]
    ranked = placed.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1) if few else global_rank(placed, order)
    base = F.coalesce(dictionary.agg(F.max("id")).scalar(), F.lit(0)) if last is None else last
    return ranked.select((base + 1 + F.col("rank")).cast("bigint").alias("id"), "address")


def looked_up(df: DataFrame, columns: dict[str, str], dictionary: DataFrame, key: str, value: str) -> DataFrame:
    """Adds, for each of ``columns`` (column -> new column), the dictionary's value of its content; null where there is none.

    Only keys move by key, each once a block, and their values come back by
    block, which bounds what meets there; the rows (with block_number) stay
    together by block. ``df`` is read for its keys and for the rows: give a
    written table or rows that cost little. A hot key is split by adaptive
    execution.
    """
    told = df.select("block_number", F.explode(F.array(*columns)).alias("_key")).filter("_key IS NOT NULL").distinct()
    book = dictionary.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    found = told.join(book, "_key").repartition("block_number").groupBy("block_number").agg(
        F.map_from_entries(F.collect_list(F.struct("_key", "_value"))).alias("_found"))
    out = df.join(found, "block_number", "left")
    return out.withColumns({new: F.try_element_at("_found", F.col(c)) for c, new in columns.items()}).drop("_found")


def swap_ids(df: DataFrame, columns: dict[str, str], dictionary: DataFrame) -> DataFrame:
    """Replace address text by its id (``columns``: text column -> id column); null stays null."""
    return looked_up(df, columns, dictionary, "address", "id").drop(*columns)


def union_events(tables: list[tuple[str, DataFrame, bool]], lo: int, hi: int) -> DataFrame:
    """All event tables in one frame; transfer columns are null in other tables."""
    parts = []
    for name, df, transfer in tables:
        own = ["from_addr", "to_addr", "value"] if transfer else []
        parts.append(df.filter(F.col("block_number").between(lo, hi)).select(
            F.lit(name).alias("table_name"), "block_number", "tx_hash", "log_index", "contract_no", *own))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
