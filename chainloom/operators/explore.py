"""Questions about the archive: totals, histories, transactions, the live tape and its status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.amounts import digits_to_decimal, fmt_amount, fmt_fee, fmt_int, group_digits, pct, short_address, short_hash, units_to_decimal
from ..functions.bigint import magnitude
from ..functions.facts import known_name, lookup
from ..functions.wide import WIDE, is_wide, wide_abs, wide_digits, wide_double, wide_lit, wide_negative, wide_sub, wide_sum, wide_zero
from ..session import stored
from .ranking import LOGS_PER_PIECE, latest_per_key

BIG = "decimal(38,0)"
DAY = "yyyy-MM-dd"


# ---- daily totals ---------------------------------------------------------------------------

def daily_rollup(transfers: DataFrame, blocks: DataFrame | None = None, frm: str = "from_addr", to: str = "to_addr",
                 key: str = "address") -> DataFrame:
    """In and out value and count per address per UTC day; a self-transfer counts on both sides.

    Both sides come out of one scan, and the sums are partly aggregated before
    they are shuffled, so a hot address costs one row per task and day.
    ``blocks`` gives the block time when the rows do not carry it. Amounts in
    limbs give totals in limbs.
    """
    limbs = is_wide(transfers, "value")
    total = wide_sum if limbs else F.sum
    rows = transfers if blocks is None else transfers.join(blocks.select("block_number", "block_time"), "block_number")
    zero, one, none = wide_lit(0) if limbs else F.lit(0).cast(BIG), F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def side(column, i, o, ic, oc):
        return F.struct(F.col(column).alias(key), i.alias("i"), o.alias("o"), ic.alias("ic"), oc.alias("oc"))
    both = F.array(side(to, F.col("value"), zero, one, none), side(frm, zero, F.col("value"), none, one))
    return (
        rows.select(F.date_format("block_time", DAY).alias("day"), F.inline(both))
        .groupBy(key, "day")
        .agg(total(F.col("i")).alias("in_value"), total(F.col("o")).alias("out_value"), F.sum("ic").alias("in_count"), F.sum("oc").alias("out_count"))
    )


MEASURES = ["in_value", "out_value", "in_count", "out_count"]


def _totals(daily: DataFrame) -> list[Column]:
    """The sum of each measure, in limbs where the values are."""
    total = wide_sum if is_wide(daily, "in_value") else F.sum
    return [(total(F.col(m)) if m.endswith("value") else F.sum(m)).alias(m) for m in MEASURES]


class Rollup:
    """Daily totals kept as one delta per folded range.

    A range's delta and its end are written under the range's batch id, the end
    last, so a replay rewrites the same folders and nothing is folded twice.
    """

    CURSOR = "rolled_to bigint, batch_id bigint"

    def __init__(self, spark: SparkSession, root: str, limbs: bool = False):
        """``limbs``: amounts are kept as 256-bit values."""
        self.spark, self.root, self.limbs = spark, root, limbs
        kind = WIDE if limbs else BIG
        self.delta = f"address string, day string, in_value {kind}, out_value {kind}, in_count bigint, out_count bigint, batch_id bigint"

    def rolled_to(self) -> int | None:
        """The end of the last folded range: one number for the job that plans the next range."""
        if not self._exists("cursor"):
            return None
        return self.spark.read.schema(self.CURSOR).parquet(f"{self.root}/cursor").agg(F.max("rolled_to").alias("r")).first()["r"]

    def _exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def fold_range(self, transfers: DataFrame, blocks: DataFrame | None, lo: int, hi: int, batch_id: int) -> None:
        """Fold blocks (lo, hi]."""
        part = transfers.filter((F.col("block_number") > lo) & (F.col("block_number") <= hi))
        daily_rollup(part, blocks).write.mode("overwrite").parquet(f"{self.root}/daily/batch_id={batch_id}")
        self.spark.createDataFrame([(hi,)], "rolled_to bigint").write.mode("overwrite").parquet(f"{self.root}/cursor/batch_id={batch_id}")

    def next_range(self, blocks: DataFrame, start: int, cursor: int, span: int) -> tuple[int, int] | None:
        """The next (lo, hi], beginning at the first block that holds rows; None when caught up.

        A rollup that is ahead of the archive's cursor is refused.
        """
        rolled = self.rolled_to()
        rolled = start if rolled is None else rolled
        if rolled > cursor:
            raise ValueError(f"the rollup is at block {rolled}, ahead of the archive at {cursor}")
        first = blocks.filter((F.col("block_number") > rolled) & (F.col("block_number") <= cursor)).agg(F.min("block_number").alias("b")).first()["b"]
        if first is None:
            return None
        return first - 1, min(cursor, first - 1 + span)

    def read(self) -> DataFrame:
        """Totals over all deltas whose range has been closed."""
        deltas = self.spark.read.schema(self.delta).parquet(f"{self.root}/daily")
        done = self.spark.read.schema(self.CURSOR).parquet(f"{self.root}/cursor").select("batch_id").distinct()
        return deltas.join(done, "batch_id", "left_semi").groupBy("address", "day").agg(*_totals(deltas))

    def compact(self, into: Rollup, batch_id: int) -> None:
        """Write the closed deltas as a single one below another root."""
        self.read().write.mode("overwrite").parquet(f"{into.root}/daily/batch_id={batch_id}")
        self.spark.createDataFrame([(self.rolled_to(),)], "rolled_to bigint").write.mode("overwrite").parquet(
            f"{into.root}/cursor/batch_id={batch_id}")


def address_totals(daily: DataFrame, address: str | None = None) -> DataFrame:
    """Sums, counts, first and last day per address; for one address always a row, of zeros when it never moved."""
    if is_wide(daily, "in_value"):
        aggs = [F.coalesce(wide_sum(F.col(m)), wide_lit(0)).alias(m) if m.endswith("value") else F.coalesce(F.sum(m), F.lit(0)).cast("bigint").alias(m) for m in MEASURES]
    else:
        aggs = [F.coalesce(F.sum(m), F.lit(0)).cast(t).alias(m) for m, t in zip(MEASURES, (BIG, BIG, "bigint", "bigint"))]
    aggs += [F.min("day").alias("first_day"), F.max("day").alias("last_day")]
    if address is None:
        return daily.groupBy("address").agg(*aggs)
    return daily.filter(F.col("address") == address).agg(*aggs).select(F.lit(address).alias("address"), "*")


def day_series(daily: DataFrame, key: str = "address", half: int = 82) -> DataFrame:
    """One row per key and day from its first to its last, empty days as zero, with square-root heights."""
    limbs = is_wide(daily, "in_value")
    top = F.greatest(F.max("in_value"), F.max("out_value"))
    span = daily.groupBy(key).agg(
        F.min(F.to_date("day")).alias("_a"), F.max(F.to_date("day")).alias("_b"), (wide_double(top) if limbs else top.cast("double")).alias("_top"))
    days = span.select(key, "_top", F.explode(F.sequence("_a", "_b")).alias("_d")).select(key, "_top", F.date_format("_d", DAY).alias("day"))

    zero = wide_lit(0) if limbs else F.lit(0)

    def height(c):
        v = wide_double(F.col(c)) if limbs else F.col(c).cast("double")
        return F.when((F.col("_top") > 0) & (v > 0), F.greatest(F.lit(1.0), F.sqrt(v / F.col("_top")) * half)).otherwise(0.0)
    x = days.join(daily, [key, "day"], "left")
    return x.select(key, "day", F.coalesce("in_value", zero).cast(WIDE if limbs else BIG).alias("in_value"),
                    F.coalesce("out_value", zero).cast(WIDE if limbs else BIG).alias("out_value"), height("in_value").alias("in_h"), height("out_value").alias("out_h"))


def rollup_behind(rolled_to: Column, head: Column, slack: int = 120) -> Column:
    return F.coalesce(rolled_to < head - slack, F.lit(False))


def rollup_state(known: DataFrame, totals: DataFrame, rolled_to: Column, head: Column, since: str) -> DataFrame:
    """Per known address: net value, whether totals lag, and what the page says of an address without any."""
    behind = rollup_behind(rolled_to, head)
    text = (
        F.when(rolled_to.isNull(), "Totals are still being added.")
        .when(behind, F.concat(F.lit("Totals are still being added (up to block "), fmt_int(rolled_to), F.lit(").")))
        .otherwise(f"No USDC movement for this address since {since}.")
    )
    x = known.join(totals.withColumn("_has", F.lit(True)), "address", "left")
    if is_wide(totals, "in_value"):
        net = F.when(F.col("_has"), wide_sub(F.col("in_value"), F.col("out_value")))
    else:
        net = (F.col("in_value") - F.col("out_value")).cast(BIG)
    return x.select("address", net.alias("net"), behind.alias("behind"),
                    F.when(F.col("_has").isNull(), text).alias("empty_text"))


# ---- an address's latest movements ----------------------------------------------------------

def movements(transfers: DataFrame, address: str | None = None) -> DataFrame:
    """Each transfer once per address it touches (a self-transfer once), with direction and counterparty."""
    rows = transfers
    if address is not None:
        rows = rows.filter((F.col("from_addr") == address) | (F.col("to_addr") == address))

    def side(me, other, way):
        return F.struct(F.col(me).alias("address"), F.col(other).alias("counterparty"), F.lit(way).alias("dir"))
    self_move = F.array(side("from_addr", "to_addr", "self"))
    both = F.array(side("from_addr", "to_addr", "out"), side("to_addr", "from_addr", "in"))
    x = rows.select("block_number", "log_index", "tx_hash", "value", "block_time",
                    F.inline(F.when(F.col("from_addr") == F.col("to_addr"), self_move).otherwise(both)))
    return x if address is None else x.filter(F.col("address") == address)


def _newest() -> list[Column]:
    return [F.col("block_number").desc(), F.col("log_index").desc()]


def address_history(transfers: DataFrame, insights: DataFrame | None = None, address: str | None = None,
                    before: tuple[int, int] | None = None, size: int = 25) -> DataFrame:
    """The latest ``size`` rows of an address (or of every address) before a position, newest first.

    ``older`` is the next page's token, set only where more rows exist. Lanes
    are joined after the page is cut.
    """
    rows = movements(transfers, address)
    if before is not None:
        rows = rows.filter(F.struct("block_number", "log_index") < F.struct(F.lit(before[0]).cast("bigint"), F.lit(before[1]).cast("int")))
    page = latest_per_key(rows, ["address"], _newest(), size + 1)
    per = Window.partitionBy("address")  # at most size + 1 rows each
    page = page.withColumn("_n", F.count("*").over(per)).filter(F.col("rn") <= size)
    token = F.concat_ws("-", F.col("block_number").cast("string"), F.col("log_index").cast("string"))
    page = page.withColumn("older", F.when((F.col("_n") > size) & (F.col("rn") == size), token)).drop("_n")
    page = page.withColumn("time", F.unix_timestamp("block_time")).drop("block_time")
    if insights is None:
        return page.withColumn("lane", F.lit(None).cast("string"))
    return page.join(insights.select("block_number", "log_index", "lane"), ["block_number", "log_index"], "left")


def address_page(archive, address: str, before: tuple[int, int] | None = None, size: int = 25) -> DataFrame:
    """``address_history`` of one address of an archive, read by its postings: newest files first, none beyond the page."""
    return address_history(archive.latest_of(address, size + 1, before), address=address, before=before, size=size)


def transaction_page(archive, tx_hash: str) -> DataFrame:
    """The rows of one transaction of an archive with names and time, read from its block's files."""
    rows = stored(archive.transaction(tx_hash), "transaction")  # one transaction: bounded by its block
    ids = [r["id"] for r in rows.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().collect()]
    blocks = [r["block_number"] for r in rows.select("block_number").distinct().collect()]
    names = archive.names_of(ids)
    for side in ("from", "to"):
        rows = rows.join(names.select(F.col("id").alias(f"{side}_id"), F.col("address").alias(f"{side}_addr")), f"{side}_id", "left")
    times = archive.read("blocks", [(b, b) for b in blocks]).select("block_number", F.unix_timestamp("block_time").alias("time"))
    return rows.join(times, "block_number", "left").select("tx_hash", "block_number", "log_index", "from_addr", "to_addr", "value", "time")


def with_lanes(rows: DataFrame, insights: DataFrame) -> DataFrame:
    """Adds ``lane`` to rows of (block_number, log_index), null where none is filed.

    Only places and lanes move, and by block, which bounds what meets: by both
    keys a block's rows would be dealt over all tasks, with the hashes they share.
    """
    filed = insights.select("block_number", "log_index", "lane").repartition("block_number").groupBy("block_number").agg(
        F.map_from_entries(F.collect_list(F.struct("log_index", "lane"))).alias("_lanes"))
    return rows.join(filed, "block_number", "left").withColumn("lane", F.try_element_at("_lanes", F.col("log_index"))).drop("_lanes")


def recent_page(transfers: DataFrame, n: int = 1000, address: str | None = None) -> DataFrame:
    """The latest ``n`` rows per address; a task sends at most ``n`` of an address on."""
    return latest_per_key(movements(transfers, address), ["address"], _newest(), n)


def recent_counterparties(transfers: DataFrame, n: int = 1000, top: int = 6, address: str | None = None) -> DataFrame:
    """Top counterparties over the latest n rows: by count, value, address. Self rows count in the total only."""
    page = recent_page(transfers, n, address)
    totals = page.groupBy("address").agg(F.count("*").alias("total"))
    cps = page.filter("dir <> 'self'").groupBy("address", "counterparty").agg(F.count("*").alias("n"), F.sum("value").cast(BIG).alias("value"))
    best = latest_per_key(cps, ["address"], [F.desc("n"), F.desc("value"), F.asc("counterparty")], top)
    return totals.join(best, "address", "left")


def recent_lanes(transfers: DataFrame, insights: DataFrame, n: int = 1000, address: str | None = None) -> DataFrame:
    """How many of an address's latest ``n`` rows are filed in which lane; those in none take a place, but are not counted.

    Lanes come to the transfers block by block, before these are told once per
    address: a row then moves once, by address, with nothing but its place and lane.
    """
    both = F.array(F.col("from_addr"), F.col("to_addr"))
    laned = with_lanes(transfers.select("block_number", "log_index", "from_addr", "to_addr"), insights)
    rows = laned.select("block_number", "log_index", "lane", F.explode(F.array_distinct(both)).alias("address"))
    page = latest_per_key(rows if address is None else rows.filter(F.col("address") == address), ["address"], _newest(), n)
    return page.filter("lane IS NOT NULL").groupBy("address", "lane").agg(F.count("*").alias("n"))


def _lane_rank(lane: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in V.LANE_ORDER]), lane)


def top_lane(counts: DataFrame, key: str = "address") -> DataFrame:
    """The most frequent lane per key; the fixed order breaks ties; uncertain and unknown lanes do not count."""
    known = counts.filter((F.col("lane") != "uncertain") & (_lane_rank(F.col("lane")) > 0))
    return known.groupBy(key).agg(F.min_by("lane", F.struct(-F.col("n"), _lane_rank(F.col("lane")))).alias("lane"))


def lane_shares(rows: DataFrame, by: list[str]) -> DataFrame:
    """Whole percent per lane in fixed order, the nine usual lanes even at zero; paused when under half has a lane."""
    counted = rows.groupBy(*by, "lane").agg(F.count("*").alias("n"))
    per = counted.groupBy(*by).agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("lane").isNotNull(), F.col("n"))), F.lit(0)).alias("laned"),
        F.map_from_entries(F.collect_list(F.when(F.col("lane").isNotNull(), F.struct("lane", "n")))).alias("_lanes"))
    lanes = F.explode(F.array(*[F.lit(x) for x in V.LANE_ORDER])).alias("lane")
    x = per.select(*by, "total", "laned", "_lanes", lanes).withColumn("n", F.coalesce(F.try_element_at("_lanes", F.col("lane")), F.lit(0)))
    return x.filter(F.col("lane").isin(V.LANES_ALWAYS) | (F.col("n") > 0)).select(
        *by, "lane", pct(F.col("n"), F.col("total")).alias("pct"), (F.col("laned") * 2 < F.col("total")).alias("paused"))


# ---- transactions ---------------------------------------------------------------------------

EVENT = f"li int, kind string, a string, b string, pool string, x {BIG}, y {BIG}, fee bigint"


def tx_rows(transfers: DataFrame, swaps: DataFrame, modifies: DataFrame, donates: DataFrame, inits: DataFrame) -> DataFrame:
    """All events of all transactions in one shape: parties a and b, pool, amounts x and y."""
    text, num, fee = F.lit(None).cast("string"), F.lit(None).cast(BIG), F.lit(None).cast("bigint")

    def shape(df, kind, a, b, pool, x, y, f):
        return df.select("tx_hash", "block_number", F.col("log_index").alias("li"), F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"),
                         pool.alias("pool"), x.cast(BIG).alias("x"), y.cast(BIG).alias("y"), f.alias("fee"))
    c = F.col
    return (
        shape(transfers, "Transfer", c("from_addr"), c("to_addr"), text, c("value"), num, fee)
        .unionByName(shape(swaps, "Swap", c("sender"), text, c("pool"), c("amount0"), c("amount1"), c("fee")))
        .unionByName(shape(modifies, "Liquidity", c("sender"), text, c("pool"), c("liquidity_delta"), num, fee))
        .unionByName(shape(donates, "Donate", c("sender"), text, c("pool"), c("amount0"), c("amount1"), fee))
        .unionByName(shape(inits, "Initialize", text, text, c("pool"), num, num, c("fee")))
    )


def tx_detail(rows: DataFrame, blocks: DataFrame, inits: DataFrame) -> DataFrame:
    """Every event with its block's time and its pool's Initialize row, wherever the pool was created."""
    pools = inits.select("pool", "currency0", "currency1", F.col("fee").alias("pool_fee"), "tick_spacing", "hooks")
    times = blocks.select("block_number", F.unix_timestamp("block_time").alias("time"))
    x = rows.join(times, "block_number", "left").join(pools, "pool", "left")
    return x.withColumn("time", F.coalesce("time", F.lit(0)).cast("bigint"))


def tx_page(rows: DataFrame, blocks: DataFrame, inits: DataFrame, tx_hash: str) -> DataFrame:
    """One transaction as one nested row: its events by log, its time, its pools."""
    d = tx_detail(rows.filter(F.col("tx_hash") == tx_hash), blocks, inits)
    event = F.struct("li", "kind", "a", "b", "pool", "x", "y", "fee")
    pool = F.when(F.col("currency0").isNotNull(), F.struct("pool", "currency0", "currency1", "pool_fee", "tick_spacing", "hooks"))
    return d.groupBy("tx_hash").agg(F.min("block_number").alias("block"), F.max("time").alias("time"),
                                    F.array_sort(F.collect_list(event)).alias("events"), F.collect_set(pool).alias("pools"))


def tx_lane(rows: DataFrame, insights: DataFrame, cursor: Column, on: bool = True) -> DataFrame:
    """The lane a transaction's page shows: of its first transfer, else of its first pool event.

    state: read, before (older than the first lane), pending (above the lane
    cursor), none (inside the range without a lane), off.
    """
    if not on:
        return rows.select("tx_hash").distinct().select("tx_hash", F.lit("off").alias("state"), *[
            F.lit(None).cast(t).alias(c) for c, t in (("lane", "string"), ("p", "double"), ("sentence", "string"))])
    first = insights.agg(F.min("block_number")).scalar()
    lab = insights.select("block_number", F.col("log_index").alias("li"), F.struct("lane", "lane_p", "sentence").alias("_l"))
    order = F.struct((F.col("kind") != "Transfer").alias("pool_event"), "li")
    x = rows.join(lab, ["block_number", "li"], "left").groupBy("tx_hash").agg(
        F.min("block_number").alias("block"), F.min_by("_l", F.when(F.col("_l").isNotNull(), order)).alias("_l"))
    state = (
        F.when(F.col("_l").isNotNull(), "read").when(F.col("block") < first, "before")
        .when(cursor.isNull() | (F.col("block") > cursor), "pending").otherwise("none")
    )
    return x.select("tx_hash", state.alias("state"), F.col("_l.lane").alias("lane"),
                    (F.floor(F.col("_l.lane_p") * 100 + 0.5) / 100).alias("p"), F.col("_l.sentence").alias("sentence"))


def first_lane_block(insights: DataFrame, blocks: DataFrame) -> DataFrame:
    first = insights.agg(F.min("block_number")).scalar()
    return blocks.filter(F.col("block_number") == first).select("block_number", F.unix_timestamp("block_time").alias("time"))


def transfer_chains(transfers: DataFrame, max_hops: int = 6) -> DataFrame:
    """Per transaction: whether each sender is the receiver before it, and the path when it is a short chain.

    Log indexes cut a transaction into pieces of bounded size; links inside a
    piece come from a window, links between pieces from the pieces' ends, so no
    task orders a whole transaction. Only short chains collect their path.
    """
    t = transfers.select("tx_hash", "log_index", "from_addr", "to_addr", F.floor(F.col("log_index") / LOGS_PER_PIECE).alias("_piece"))
    inner = Window.partitionBy("tx_hash", "_piece").orderBy("log_index")
    linked = t.withColumn("_before", F.lag("to_addr").over(inner)).withColumn(
        "_ok", F.col("_before").isNull() | (F.col("_before") == F.col("from_addr")))
    hop = F.struct("log_index", "from_addr", "to_addr")
    numbered = linked.withColumn("_rn", F.row_number().over(inner))
    pieces = numbered.groupBy("tx_hash", "_piece").agg(
        F.count("*").alias("_n"), F.bool_and("_ok").alias("_ok"), F.min_by("from_addr", "log_index").alias("_first"),
        F.max_by("to_addr", "log_index").alias("_last"),
        F.array_sort(F.collect_list(F.when(F.col("_rn") <= max_hops, hop))).alias("_hops"))
    outer = Window.partitionBy("tx_hash").orderBy("_piece")
    joined = pieces.withColumn("_at", F.row_number().over(outer)).withColumn("_prev", F.lag("_last").over(outer)).withColumn(
        "_ok", F.col("_ok") & (F.col("_prev").isNull() | (F.col("_prev") == F.col("_first"))))
    out = joined.groupBy("tx_hash").agg(
        F.sum("_n").alias("n"), F.bool_and("_ok").alias("is_chain"),
        F.flatten(F.array_sort(F.collect_list(F.when(F.col("_at") <= max_hops, F.col("_hops"))))).alias("_hops"))
    first = F.element_at("_hops", 1)["from_addr"]
    nodes = F.concat(F.array(first), F.transform("_hops", lambda h: h["to_addr"]))
    return out.select("tx_hash", "n", "is_chain", F.when(F.col("is_chain") & (F.col("n") <= max_hops), nodes).alias("path"))


def usdc_decimals(currency: Column) -> Column:
    return lookup({k: str(v[1]) for k, v in V.USDC_FACES.items()}, F.lower(currency)).cast("int")


def tx_kind(rows: DataFrame, inits: DataFrame, chains: DataFrame) -> DataFrame:
    """What a transaction did, and the amount its headline names (raw units with their decimals)."""
    k = F.col("kind")
    is_t, is_s = k == "Transfer", k == "Swap"
    hop = F.struct("a", "b", "x")
    per = rows.groupBy("tx_hash").agg(
        F.min_by(F.struct("pool", "x", "y"), F.when(is_s, F.col("li"))).alias("s"), F.count_if(is_s).alias("n_s"),
        F.min_by(hop, F.when(is_t, F.col("li"))).alias("first"), F.max_by(hop, F.when(is_t, F.col("li"))).alias("last"),
        F.count_if(is_t).alias("n_t"), F.sum(F.when(is_t, F.col("x"))).alias("total"),
        F.count_if(k == "Initialize").alias("n_i"), F.count_if(k == "Liquidity").alias("n_m"))
    pools = inits.select(F.col("pool").alias("_pool"), "currency0", "currency1")
    x = per.withColumn("_pool", F.when(F.col("n_s") > 0, F.col("s.pool"))).join(pools, "_pool", "left").join(
        chains.select("tx_hash", "is_chain"), "tx_hash", "left")
    d0, d1 = usdc_decimals(F.col("currency0")), usdc_decimals(F.col("currency1"))
    delta = F.when(d0.isNotNull(), F.col("s.x")).when(d1.isNotNull(), F.col("s.y"))
    x = x.withColumn("_delta", delta).withColumn("_dec", F.coalesce(d0, d1))
    swapped, moved = F.col("n_s") > 0, F.col("n_t") > 0
    first, last, zero = F.col("first"), F.col("last"), F.lit(V.ZERO_ADDRESS)
    kind = (
        F.when(swapped & (F.col("_delta") < 0), "swap out").when(swapped & (F.col("_delta") > 0), "swap in").when(swapped, "swap")
        .when(~moved & (F.col("n_i") > 0), "pool created").when(~moved & (F.col("n_m") > 0), "liquidity").when(~moved, "donate")
        .when(F.col("is_chain") & (first["a"] == zero), "mint").when(F.col("is_chain") & (last["b"] == zero), "burn")
        .when(F.col("is_chain") & (F.col("n_t") == 1) & (first["a"] == first["b"]), "self").when(F.col("is_chain"), "paid").otherwise("many")
    )
    x = x.withColumn("kind", kind)
    amount = (
        F.when(F.col("kind").isin("swap out", "swap in"), magnitude(F.col("_delta"))).when(F.col("kind") == "mint", last["x"])
        .when(F.col("kind").isin("burn", "self", "paid"), first["x"]).when(F.col("kind") == "many", F.col("total"))
    )
    decimals = F.when(F.col("kind").startswith("swap"), F.col("_dec")).otherwise(V.NATIVE_DECIMALS)
    return x.select("tx_hash", "kind", amount.cast(BIG).alias("amount"), F.when(amount.isNotNull(), decimals).alias("decimals"))


def swap_sides(swaps: DataFrame, inits: DataFrame, tokens: DataFrame) -> DataFrame:
    """What each swap paid and received: text amount, token, note; raw integer where decimals are unknown. Amounts are decimals or limbs."""
    limbs = is_wide(swaps, "amount0")
    pools = inits.select("pool", "currency0", "currency1")
    x = swaps.join(pools, "pool", "left")
    for i in ("0", "1"):
        t = tokens.select(F.col("address").alias(f"currency{i}"), F.col("symbol").alias(f"_sym{i}"), F.col("decimals").alias(f"_dec{i}"))
        x = x.join(t, f"currency{i}", "left")

    # stated as columns step by step, so that each text is worked out once per row
    for i in ("0", "1"):
        address = F.col(f"currency{i}")
        face = lookup({k: v[0] for k, v in V.USDC_FACES.items()}, address)
        x = x.withColumn(f"_face{i}", face).withColumn(
            f"_size{i}", wide_digits(wide_abs(F.col(f"amount{i}"))) if limbs else magnitude(F.col(f"amount{i}")).cast("string"))
        x = x.withColumn(f"_dec{i}", F.when(F.col(f"_face{i}").isNotNull(), usdc_decimals(address)).otherwise(F.col(f"_dec{i}")))
        x = x.withColumn(f"_units{i}", digits_to_decimal(F.col(f"_size{i}"), F.coalesce(f"_dec{i}", F.lit(0))))
        unknown = F.col(f"_dec{i}").isNull()
        amount = F.when(unknown, group_digits(F.col(f"_size{i}"))).otherwise(fmt_amount(F.col(f"_units{i}"), limbs))
        symbol = F.coalesce(f"_face{i}", f"_sym{i}")
        token = F.coalesce(symbol, short_address(address))
        note = F.concat(F.coalesce(symbol, F.concat(F.lit("token "), token)), F.when(unknown, " · decimals unknown").otherwise(""))
        x = x.withColumn(f"_side{i}", F.struct(amount.alias("amount"), token.alias("token"), note.alias("note")))
    known, d0, d1 = F.col("currency0").isNotNull(), F.col("amount0"), F.col("amount1")
    below = wide_negative if limbs else lambda d: d < 0
    above = (lambda d: ~wide_negative(d) & ~wide_zero(d)) if limbs else lambda d: d > 0
    return x.select(
        "tx_hash", "log_index", F.when(known & below(d0), F.col("_side0")).when(known & below(d1), F.col("_side1")).alias("paid"),
        F.when(known & above(d0), F.col("_side0")).when(known & above(d1), F.col("_side1")).alias("received"),
        fmt_fee(F.col("fee")).alias("fee"), known.alias("known"))


def tx_events(rows: DataFrame) -> DataFrame:
    """The event list of a transaction, by log: kind, parties as text, amount of a transfer."""
    pool = F.concat(F.lit("pool "), short_hash(F.col("pool")))
    parties = (
        F.when(F.col("kind") == "Transfer", F.concat_ws(" → ", "a", "b"))
        .when(F.col("kind") == "Swap", F.concat(pool, F.lit(" · sender "), F.col("a")))
        .when(F.col("kind") == "Liquidity", F.concat(pool, F.when(F.col("x") < 0, " · removed by ").otherwise(" · added by "), F.col("a")))
        .when(F.col("kind") == "Donate", F.concat(pool, F.lit(" · from "), F.col("a")))
        .otherwise(F.concat(pool, F.lit(" created · fee "), fmt_fee(F.col("fee"))))
    )
    amount = F.when(F.col("kind") == "Transfer", F.concat(fmt_amount(units_to_decimal(F.col("x"), 18)), F.lit(" USDC")))
    return rows.select("tx_hash", "li", "kind", parties.alias("parties"), amount.alias("amount"))


# ---- the live tape --------------------------------------------------------------------------

def held_through(blocks: DataFrame, now: Column, hold_ms: int = 8000) -> Column:
    """The newest block ingested at least the hold ago."""
    return blocks.filter(F.col("_ingested_at") <= now - F.make_dt_interval(secs=F.lit(hold_ms / 1000))).agg(F.max("block_number")).scalar()


def release_to(rows: DataFrame) -> DataFrame:
    """Adds ``to`` to (cursor, lane_cursor, held, lanes_on): rows wait for their lane, but only so long, and never pass the cursor."""
    cursor = F.col("cursor")
    lanes = F.least(F.coalesce("lane_cursor", F.lit(-1)), cursor)
    held = F.least(F.coalesce("held", F.lit(-1)), cursor)
    return rows.withColumn("to", F.when(cursor.isNull(), None).when(~F.col("lanes_on"), cursor).otherwise(F.greatest(lanes, held)))


def move_struct() -> Column:
    return F.struct(F.col("log_index").alias("li"), F.col("tx_hash").alias("tx"), F.col("from_addr").alias("from"), F.col("to_addr").alias("to"),
                    known_name(F.col("from_addr")).alias("from_name"), known_name(F.col("to_addr")).alias("to_name"),
                    units_to_decimal(F.col("value"), 18).alias("value"), "lane")


def _messages(rows: DataFrame) -> DataFrame:
    """Nested moves per block, in log order; a block holds a bounded number of logs."""
    return rows.groupBy(F.col("block_number").alias("n")).agg(
        F.min(F.unix_timestamp("block_time")).alias("t"), F.array_sort(F.collect_list(move_struct())).alias("moves"))


def page_end(transfers: DataFrame, lo: Column | int, hi: Column | int, cap: int = 50_000) -> Column:
    """The last block of a page of (lo, hi]: whole blocks of at most ``cap`` movements together, one block at least.

    A reader goes on with this block as its next ``lo``, so no page loses a movement.
    """
    n = F.col("block_number")
    first = transfers.filter((n > lo) & (n <= hi)).select(n).orderBy(n).limit(cap + 1)
    whole = F.when(F.count("*") <= cap, F.lit(hi)).otherwise(F.greatest(F.max(n) - 1, F.min(n)))
    return first.agg(whole).scalar()


def block_messages(transfers: DataFrame, insights: DataFrame, lo: Column | int, hi: Column | int) -> DataFrame:
    """One message per block of (lo, hi] with all its movements; ``page_end`` gives ranges of bounded size."""
    inside = (F.col("block_number") > lo) & (F.col("block_number") <= hi)
    return _messages(with_lanes(transfers.filter(inside), insights.filter(inside)))


def catch_up(rows: DataFrame, max_gap: int = 600, tail: int = 150) -> DataFrame:
    """Adds mode, lo, hi to (cursor, target, released): nothing, next (lo, hi], the latest blocks, or a restart."""
    to, done = F.col("target"), F.col("released")
    back = F.col("cursor").isNotNull() & (F.col("cursor") < done - max_gap)
    mode = (
        F.when(done.isNull(), F.when(to.isNull() | (to < 0), "nothing").otherwise("latest"))
        .when(to.isNull(), "nothing").when(back, F.when(to < 0, "nothing").otherwise("restart"))
        .when(to <= done, "nothing").when(to - done > max_gap, "latest").otherwise("next")
    )
    x = rows.withColumn("mode", mode)
    return x.withColumn("lo", F.when(F.col("mode") == "next", done).when(F.col("mode") != "nothing", to - tail)).withColumn(
        "hi", F.when(F.col("mode") != "nothing", to))


def latest_moves(transfers: DataFrame, insights: DataFrame, n: int = 40) -> DataFrame:
    """The newest n movements as block messages; the oldest block may be partial."""
    top = transfers.orderBy(*_newest()).limit(n)
    return _messages(top.join(insights.select("block_number", "log_index", "lane"), ["block_number", "log_index"], "left"))


def resume_after(messages: DataFrame, latest: DataFrame, last_id: int | None, trimmed: Column) -> DataFrame:
    """Messages newer than the last one a viewer saw while that one is inside the buffer, else the latest moves."""
    last = F.lit(last_id).cast("bigint")
    newest = messages.agg(F.max("n")).scalar()
    inside = F.coalesce((last >= trimmed) & (last <= newest), F.lit(False))
    cols = ["n", "t", "moves"]
    return messages.filter(inside & (F.col("n") > last)).select(*cols).unionByName(latest.filter(~inside).select(*cols))


def archive_status(rows: DataFrame, batch: int = 1000, behind_s: int = 15) -> DataFrame:
    """Adds lag, phase and state to (current, head, previous, failed, open, newest_time, now).

    An archive that was live stays live while one round reaches the head;
    any other one with blocks to read is backfilling.
    """
    lag = F.greatest(F.col("head") - F.col("current"), F.lit(0))
    age = F.floor(F.col("now") - F.col("newest_time") + 0.5)
    near = (F.col("previous") == "Live") & (lag <= batch)
    phase = (
        F.when(F.col("failed"), "Degraded").when(F.col("current").isNull(), "Provisioning")
        .when((lag == 0) | near, "Live").otherwise("Backfilling")
    )
    state = F.when(~F.col("open"), "down").when(age > behind_s, _lag_text(age)).otherwise("live")
    return rows.withColumn("lag", lag).withColumn("phase", phase).withColumn("state", state)


def _lag_text(seconds: Column) -> Column:
    def say(v, unit):
        return F.concat(fmt_int(F.floor(v + 0.5)), F.lit(unit))
    return (
        F.when(seconds < 120, say(seconds, " s behind")).when(seconds < 7200, say(seconds / 60, " min behind"))
        .when(seconds < 48 * 3600, say(seconds / 3600, " h behind")).otherwise(say(seconds / 86400, " days behind"))
    )
