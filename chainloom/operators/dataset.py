"""Building the question data set: phrasings, caps, nonsense, gold answers, rows, leaks, recipes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.scoring import hash32
from ..functions.text import avoided, normalize
from .ranking import global_rank

SMOOTH = 0.05


def split_phrasings(phrasings: DataFrame) -> DataFrame:
    """Adds ``split`` to (topic, lang, pos, text, held_out): which askings may train.

    A training topic's last two English phrasings and its last Turkish one are
    held back; a held-out topic and other languages never train.
    """
    sizes = phrasings.groupBy("topic", "lang").agg(F.count("*").alias("_n"))
    left = F.col("_n") - F.col("pos")  # 1 for the last one
    split = (
        F.when(~F.col("lang").isin("en", "tr"), "heldout-language").when(F.col("held_out"), "heldout-topic")
        .when(left <= F.when(F.col("lang") == "en", 2).otherwise(1), "heldout-phrasing").otherwise("train")
    )
    return phrasings.join(sizes, ["topic", "lang"]).withColumn("split", split).drop("_n")


def distinct_stories(items: DataFrame, story: str, shape: str, order: list[str], keep: list[str]) -> DataFrame:
    """The first item per story stands for all; ``one_shape`` says the story had a single shape."""
    first = F.min_by(F.struct(shape, *keep), F.struct(*order)).alias("_f")
    same = (F.min(shape) == F.max(shape)).alias("one_shape")
    return items.groupBy(story).agg(first, same, F.count("*").alias("copies")).select(story, "_f.*", "one_shape", "copies")


def seeded(seed: int, *parts: Column) -> Column:
    """A text whose order is a fixed shuffle for a seed."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *parts))


def cap_classes(truths: DataFrame, per: int = 300, ratio: int = 3, floor: int = 50, seed: int = 0) -> DataFrame:
    """At most min(per, max(floor, ratio * minority)) stories per topic and answer, in a seeded order.

    The rank is limited map-side to ``per`` before the shuffle, so a topic's
    common answer never gathers in one task.
    """
    decided = truths.filter("truth IS NOT NULL")
    counts = decided.groupBy("topic").agg(F.count_if("truth").alias("_y"), F.count_if(~F.col("truth")).alias("_n"))
    caps = counts.select("topic", F.least(F.lit(per), F.greatest(F.lit(floor), ratio * F.least("_y", "_n"))).alias("_cap"))
    w = Window.partitionBy("topic", "truth").orderBy("_h", "story")
    x = decided.withColumn("_h", seeded(seed, F.col("topic"), F.col("story")))
    x = x.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per)
    return x.join(caps, "topic").filter("_rn <= _cap").drop("_h", "_rn", "_cap")


def pick_phrasings(chosen: DataFrame, phrasings: DataFrame, each: int = 2, seed: int = 0) -> DataFrame:
    """``each`` training phrasings per chosen (topic, story), as qid ``topic.k`` and text.

    A topic's few phrasings travel as one array and are drawn inside the row.
    """
    bank = phrasings.filter("split = 'train'").groupBy("topic").agg(F.array_sort(F.collect_list("text")).alias("_texts"))
    x = chosen.join(bank, "topic")
    order = F.array_sort(F.transform("_texts", lambda t: F.struct(seeded(seed, F.col("topic"), F.col("story"), t).alias("h"), t.alias("text"))))
    drawn = F.transform(F.slice(order, 1, each), lambda s: s["text"])
    x = x.select(*chosen.columns, F.posexplode(drawn).alias("k", "text"))
    return x.withColumn("qid", F.concat_ws(".", "topic", F.col("k").cast("string"))).drop("k")


def add_nonsense(states: DataFrame, n_rules: int, questions: DataFrame, share: float = 0.05, seed: int = 0) -> DataFrame:
    """int(n_rules * share) extra questions answered no, state and question each drawn with replacement.

    States and the distinct texts of ``questions(text)`` get dense positions, so a
    draw is a join on two numbers and any count of draws is spread over the cluster.
    """
    places = global_rank(states.select("state").distinct(), ["state"], "_s")
    asked = global_rank(questions.select("text").distinct(), ["text"], "_q")
    k = F.col("id").cast("string")

    def drawn(mark: str, bank: DataFrame) -> Column:
        return F.pmod(hash32(F.concat_ws("|", F.lit(f"{seed}{mark}"), k)), bank.agg(F.count("*")).scalar())
    draws = states.sparkSession.range(int(n_rules * share)).select(
        F.concat(F.lit("nonsense."), k).alias("qid"), drawn("s", places).alias("_s"), drawn("q", asked).alias("_q"))
    return draws.join(places, "_s").join(asked, "_q").select("state", "qid", "text", F.lit(False).alias("yes"))


def noul_gold(yes: Column, smooth: float = SMOOTH) -> Column:
    """Soft yes/no target as a map."""
    hi, lo = F.lit(1 - smooth), F.lit(smooth)
    return F.create_map(F.lit("true"), F.when(yes, hi).otherwise(lo), F.lit("false"), F.when(yes, lo).otherwise(hi))


def lane_gold(lane: Column, smooth: float = SMOOTH) -> Column:
    """Soft lane target: the lane, and the rest shared evenly."""
    lanes = F.array(*[F.lit(k) for k in V.LANES])
    return F.map_from_arrays(lanes, F.transform(lanes, lambda k: F.when(k == lane, 1 - smooth).otherwise(smooth / (len(V.LANES) - 1))))


def is_val(text: Column, one_in: int = 10) -> Column:
    """One state in ``one_in`` is validation, by the hash of its text."""
    return F.pmod(hash32(text), F.lit(one_in)) == 0


GOLD = "map<string,map<string,double>>"


def assemble_rows(asked: DataFrame, lanes: DataFrame, replay: DataFrame, repeats: int = 3) -> DataFrame:
    """(split, state, questions, gold) rows.

    ``asked(state, shape, qid, text, yes)`` and ``replay(state, text, p)`` are
    merged per state, replay answers unsmoothed and only on known states;
    ``lanes(shape, lane)`` become rows of their own, repeated in training. A
    state's entries are bounded by the number of question ids.
    """
    prefix = F.lit(V.RULE_PREFIX)
    shapes = asked.groupBy("state").agg(F.min("shape").alias("shape"))
    mine = asked.groupBy("state", "qid").agg(F.min(F.struct("text", "yes")).alias("a")).select(
        "state", "qid", F.concat(prefix, "a.text").alias("q"), noul_gold(F.col("a.yes")).alias("g"))
    per = Window.partitionBy("state").orderBy("text")  # a handful of replay questions per state
    back = replay.groupBy("state", "text").agg(F.max("p").alias("p")).join(shapes.select("state"), "state", "left_semi")
    back = back.withColumn("k", F.row_number().over(per) - 1).select(
        "state", F.concat(F.lit("replay."), F.col("k").cast("string")).alias("qid"), F.concat(prefix, "text").alias("q"),
        F.create_map(F.lit("true"), F.col("p"), F.lit("false"), 1 - F.col("p")).alias("g"))
    merged = mine.unionByName(back).groupBy("state").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("qid", "q")))).alias("questions"),
        F.map_from_entries(F.collect_list(F.struct("qid", "g"))).alias("gold"))

    def part(c):
        return F.when(is_val(F.col(c)), "val").otherwise("train").alias("split")
    rules = merged.join(shapes, "state").select(part("shape"), "state", "questions", F.col("gold").cast(GOLD).alias("gold"))
    lane_rows = lanes.select(
        part("shape"), F.col("shape").alias("state"), F.create_map(F.lit("lane"), F.lit(V.LANE_QUESTION)).alias("questions"),
        F.create_map(F.lit("lane"), lane_gold(F.col("lane"))).cast(GOLD).alias("gold"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("split") == "val", 1).otherwise(repeats))).alias("_t")
    return rules.unionByName(lane_rows.select("*", times).drop("_t"))


def row_stats(rows: DataFrame) -> DataFrame:
    """(split, key, n): rows, questions, topic:answer and lane counts; replay questions are not counted."""
    flat = rows.select("split", F.explode("gold").alias("qid", "g")).filter(~F.col("qid").startswith("replay."))
    best = F.element_at(F.array_sort(F.transform(F.map_entries("g"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), 1)["k"]
    answer = F.when(F.element_at("g", "true") > F.element_at("g", "false"), "yes").otherwise("no")
    key = F.when(F.col("qid") == "lane", F.concat(F.lit("lane:"), best)).otherwise(
        F.concat(F.lit("topic:"), F.split_part("qid", F.lit("."), F.lit(1)), F.lit(":"), answer))
    counts = flat.groupBy("split", key.alias("key")).agg(F.count("*").alias("n"))
    total = counts.groupBy("split").agg(F.sum("n").alias("n")).select("split", F.lit("questions").alias("key"), "n")
    size = rows.groupBy("split").agg(F.count("*").alias("n")).select("split", F.lit("rows").alias("key"), "n")
    return counts.unionByName(total).unionByName(size)


def audit_sample(rows: DataFrame, n: int = 60, seed: int = 0) -> DataFrame:
    """n labelled training questions in a seeded order, to be read by hand."""
    flat = rows.filter("split = 'train'").select("state", F.explode("questions").alias("qid", "q"), "gold").filter("qid <> 'lane'")
    g = F.element_at("gold", F.col("qid"))
    x = flat.select("state", "qid", F.substr("q", F.lit(len(V.RULE_PREFIX) + 1)).alias("question"),
                    (F.element_at(g, "true") > F.element_at(g, "false")).alias("yes"))
    return x.orderBy(seeded(seed, F.col("state"), F.col("qid")), "state", "qid").limit(n)


#: Distinct avoided words that ``leaks`` takes; every text is tried for every word.
MOST_WORDS = 10_000


def leaks(rows: DataFrame, forbidden: DataFrame, words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """Adds ``leaked`` (the normalised text is a forbidden one) and ``avoided`` (it holds an avoided word).

    ``words(word)`` is a short vocabulary written by hand: its distinct words
    travel as one array, and more than ``most`` of them are an error.
    """
    bad = forbidden.select(normalize(F.col("text")).alias("_n")).distinct().withColumn("leaked", F.lit(True))
    few = words.select("word").distinct().limit(most + 1).agg(F.collect_list("word").alias("w"))
    listed = few.select(F.when(F.size("w") > most, F.raise_error(F.lit(f"more than {most} avoided words"))).otherwise(F.col("w"))).scalar()
    x = rows.withColumn("_n", normalize(F.col("text"))).join(bad, "_n", "left").withColumn("_w", listed)
    return x.withColumn("leaked", F.coalesce("leaked", F.lit(False))).withColumn("avoided", avoided(F.col("text"), F.col("_w"))).drop("_n", "_w")


def replay_sample(stories: DataFrame, questions: DataFrame, each: int = 6, seed: int = 0) -> DataFrame:
    """``each`` distinct questions per story, or all if there are fewer: the same ones for the same seed.

    The distinct texts of ``questions(text)`` stand in a seeded order; a story
    starts at a place of its own and takes equal strides, so every draw is a join
    on a dense number, however long the bank is.
    """
    bank = questions.select("text").distinct().withColumn("_h", seeded(seed, F.col("text")))
    bank = global_rank(bank, ["_h", "text"], "_at").select("_at", F.col("text").alias("question"))
    n = F.col("_n")
    turns = F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("_j")
    x = stories.withColumn("_n", bank.agg(F.count("*")).scalar()).select("story", "_n", turns).filter(F.col("_j") < n)
    start = hash32(F.concat_ws("|", F.lit(f"{seed}r"), "story"))
    at = F.pmod(start + F.col("_j") * F.greatest(F.lit(1), F.floor(n / each)), n)
    return x.withColumn("_at", at).join(bank, "_at").select("story", "question")


def replay_answers(sample: DataFrame, scorer: Callable[[str, list[str]], list[float]], chunk: int = 16) -> DataFrame:
    """The scorer's answer to every (story, question): one question and at most ``chunk`` stories per call."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for question, group in frame.groupby("question", sort=False):
                for at in range(0, len(group), chunk):
                    part = group.iloc[at:at + chunk]
                    ps = scorer(question, part["story"].tolist())
                    yield pd.DataFrame({"story": part["story"], "question": question, "p": [round(float(p), 4) for p in ps]})
    return sample.select("story", "question").sortWithinPartitions("question").mapInPandas(run, "story string, question string, p double")


# ---- synthetic transfers --------------------------------------------------------------------

UNKNOWN_SELECTOR = "0xdeadbeef"

# Fixed values: (name, selector, topics, called contract, pool factory, mint, burn, readable).
RECIPES = [
    ("uniswap_swap", "0x3593564c", [V.SWAP_V3], V.UNIVERSAL_ROUTER, None, False, False, True),
    ("uniswap_swap_fee", "0x3593564c", [V.SWAP_V3, V.HOOK_FEE], V.UNIVERSAL_ROUTER, None, False, False, True),
    ("okx_swap_fee", "0x0c307f76", [V.OKX_FEE], None, None, False, False, True),
    ("kyber_swap", "0xe21fd0e9", [], None, None, False, False, True),
    ("oneinch_swap", "0x07ed2379", [], None, None, False, False, True),
    ("zerox_swap", "0x2213bc0b", [], None, None, False, False, True),
    ("aerodrome_swap", "0x38ed1739", [V.SWAP_V3], None, V.AERODROME_FACTORY, False, False, True),
    ("launchpad_buy", "0x2afaca20", [], None, None, False, False, True),
    ("cctp_out", "0x8e0250ee", [], None, None, False, True, True),
    ("cctp_in", "0x57ecfd28", [], None, None, True, False, True),
    ("relay_out", UNKNOWN_SELECTOR, [V.RELAY_DEPOSIT], None, None, False, False, True),
    ("relay_swap_out", "0x3593564c", [V.SWAP_V3, V.RELAY_DEPOSIT], V.UNIVERSAL_ROUTER, None, False, False, True),
    ("lifi_out_fee", UNKNOWN_SELECTOR, [V.LIFI_STARTED, V.FEES_FORWARDED], None, None, False, False, True),
    ("across_fill_in", "0xdeff4b24", [], None, None, False, False, True),
    ("intent_fill_in", "0x7e7fc653", [], None, None, False, False, True),
    ("liquidity_v4", "0xdd46508f", [], V.POSITION_MANAGER, None, False, False, True),
    ("liquidity_v3", UNKNOWN_SELECTOR, [V.INCREASE_LIQUIDITY], None, None, False, False, True),
    ("liquidity_aerodrome", UNKNOWN_SELECTOR, [V.MINT_V3], None, V.AERODROME_FACTORY, False, False, True),
    ("vault_deposit", UNKNOWN_SELECTOR, [V.ERC4626_DEPOSIT], None, None, False, False, True),
    ("vault_withdraw", UNKNOWN_SELECTOR, [V.ERC4626_WITHDRAW], None, None, False, False, True),
    ("wrap", UNKNOWN_SELECTOR, [V.WRAP_DEPOSIT], None, None, False, False, True),
    ("wrap_swap", "0x3593564c", [V.SWAP_V3, V.WRAP_WITHDRAWAL], V.UNIVERSAL_ROUTER, None, False, False, True),
    ("lending_borrow", UNKNOWN_SELECTOR, [V.BORROW], None, None, False, False, True),
    ("lending_repay", UNKNOWN_SELECTOR, [V.REPAY], None, None, False, False, True),
    ("seaport", "0x87201b41", [V.ORDER_FULFILLED], None, None, False, False, True),
    ("disperse", "0xc73a2d60", [], None, None, False, False, True),
    ("claim", "0x4e71d92d", [V.CLAIMED], None, None, False, False, True),
    ("signed", "0xe3ee160e", [V.AUTHORIZATION_USED], V.USDC, None, False, False, True),
    ("smart_account", "0x765e827f", [V.USER_OPERATION], None, None, False, False, True),
    ("smart_account_swap", "0x765e827f", [V.SWAP_V3, V.USER_OPERATION], None, None, False, False, True),
    ("plain_erc20", "0xa9059cbb", [], V.USDC, None, False, False, True),
    ("plain_native", "0x", [], None, None, False, False, True),
    ("unknown_call", "0x12345678", [], None, None, False, False, True),
    ("unreadable", UNKNOWN_SELECTOR, [], None, None, False, False, False),
    ("issuance_mint", "0x40c10f19", [], V.USDC, None, True, False, True),
    ("issuance_burn", "0x42966c68", [], V.USDC, None, False, True, True),
]

# One raw amount (six decimals) per bucket, and the parties' kinds.
AMOUNTS = [0, 4_000, 500_000, 25_000_000, 2_500_000_000, 50_000_000_000]
PAIRS = [("wallet", "contract"), ("contract", "wallet"), ("contract", "contract"), ("wallet", "wallet")]
MINT_PAIRS = [("zero", "wallet"), ("zero", "contract")]
BURN_PAIRS = [("wallet", "zero"), ("contract", "zero")]


def expand_recipes(parties: DataFrame, recipes: list[tuple] = RECIPES, amounts: list[int] = AMOUNTS) -> DataFrame:
    """Every recipe with every pair of party kinds and every amount, numbered in a fixed order, for each party set.

    ``parties(wallet0, wallet1, contract0, contract1)``: slot 0 sends, slot 1
    receives. The fixed cases are one literal array that each row unfolds.
    """
    cases, n = [], 0
    for name, selector, topics, to, factory, mint, burn, readable in recipes:
        for frm, dst in MINT_PAIRS if mint else BURN_PAIRS if burn else PAIRS:
            for value in amounts:
                n += 1
                cases.append((n, name, selector, ",".join(topics), to, factory, readable, frm, dst, value))
    sql = ", ".join("struct(" + ", ".join("cast(null as string)" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool)
                                          else f"cast({v} as bigint)" for v in c) + ")" for c in cases)
    names = ["n", "recipe", "selector", "topics", "called", "factory", "readable", "frm", "dst", "value"]
    x = parties.select("*", F.explode(F.expr(f"array({sql})")).alias("c"))
    x = x.select(*parties.columns, *[F.col(f"c.col{i + 1}").alias(c) for i, c in enumerate(names)])

    def address(kind, slot):
        return F.when(F.col(kind) == "zero", V.ZERO_ADDRESS).when(F.col(kind) == "wallet", F.col(f"wallet{slot}")).otherwise(F.col(f"contract{slot}"))
    x = x.withColumn("from_addr", address("frm", 0)).withColumn("to_addr", address("dst", 1))
    pool, elsewhere, emitter = "0x" + "b1" * 20, "0x" + "c9" * 20, "0x" + "e1" * 20
    topics = F.when(F.col("topics") == "", F.array().cast("array<string>")).otherwise(F.split("topics", ","))
    by = F.when(F.col("factory").isNotNull(), pool).otherwise(emitter)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    ctx = F.struct(
        F.coalesce("called", F.lit(elsewhere)).alias("to"), "selector", topics.alias("topics"),
        F.when(F.col("from_addr") == V.ZERO_ADDRESS, F.col("wallet0")).otherwise(F.col("from_addr")).alias("sender"),
        F.transform(topics, lambda t: by).alias("emitters"),
        F.when(F.col("factory").isNotNull(), F.create_map(F.lit(pool), F.col("factory"))).otherwise(none).alias("factories"),
        F.lit(None).cast("boolean").alias("value_sent"))

    def kind(c):
        return F.when(F.col(c) == "contract", True).when(F.col(c) == "wallet", False)
    return x.select(
        *parties.columns, "n", "recipe", F.lower(F.concat(F.lit("0x"), F.lpad(F.hex("n"), 64, "0"))).alias("tx_hash"), "from_addr", "to_addr",
        F.col("value").cast("decimal(38,0)").alias("value"), F.when(F.col("readable"), ctx).alias("ctx"), kind("frm").alias("from_kind"),
        kind("dst").alias("to_kind"), F.lit(True).alias("is_transfer"))


def distinct_cases(rows: DataFrame, expected: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One case per distinct expected output; the first one in order stands for it."""
    key = F.sha2(F.to_json(F.struct(*expected), {"ignoreNullFields": "false"}), 256)
    return rows.groupBy(key.alias("case")).agg(F.min_by(F.struct(*expected, *keep), F.struct(*order)).alias("_f")).select("_f.*")
