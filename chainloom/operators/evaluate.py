"""Judging a scorer: yes lines, separation, AUC, balanced accuracy, agreement, truths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.facts import fact_lane
from ..streaming.live import logit
from .ranking import latest_per_key, total_before

MIN_COUNT = 10
MIN_SEPARATION = 0.12


def yes_line(scores: DataFrame) -> DataFrame:
    """Where yes starts: the log-odds midpoint of the second lowest and second highest probe answer.

    Both ranks are cut to two before the shuffle, however many answers a question has.
    """
    answers = scores.filter("p IS NOT NULL").select("question", "p")

    def second(order: Column, name: str) -> DataFrame:
        return latest_per_key(answers, ["question"], [order], 2).filter("rn = 2").select("question", F.col("p").alias(name))
    x = scores.groupBy("question").agg(F.count("p").alias("n"))
    x = x.join(second(F.col("p").asc(), "low"), "question", "left").join(second(F.col("p").desc(), "high"), "question", "left")
    line = 1 / (1 + F.exp(-(logit(F.col("low")) + logit(F.col("high"))) / 2))
    return x.select("question", F.when(F.col("n") < 4, 0.5).otherwise(
        F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.01), line)), 4)).alias("line"))


def separation(scores: DataFrame, accept: float = MIN_SEPARATION) -> DataFrame:
    """Mean of the top fifth minus mean of the bottom fifth, at least two answers each.

    Answers are counted per distinct score; a score's place among its question's
    answers says how many of them lie in either fifth.
    """
    per = scores.groupBy("question", "p").agg(F.count("p").alias("c"))
    sizes = per.groupBy("question").agg(F.sum("c").alias("n"))
    x = total_before(per, ["question", "p"], "c")
    first = x.groupBy("question").agg(F.min("before").alias("_first"))
    x = x.join(sizes.join(first, "question"), "question")
    edge, at, c = F.greatest(F.lit(2), F.floor(F.col("n") / 5)), F.col("before") - F.col("_first"), F.col("c")

    def total(share):
        return F.coalesce(F.sum(F.col("p") * F.least(c, F.greatest(F.lit(0), share))), F.lit(0.0))
    gap = (total(at + c - (F.col("n") - edge)) - total(edge - at)) / F.max(edge)
    return x.groupBy("question").agg(gap.alias("separation")).withColumn("accepted", F.col("separation") >= accept)


def auc(scores: DataFrame, by: str = "question") -> DataFrame:
    """Rank-sum AUC with midranks over (by, p, label).

    Rows are first counted per distinct score, and the noes before a score come
    from one distributed order of those counts: no task holds a question's scores.
    """
    per = scores.groupBy(by, "p").agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    x = total_before(per, [by, "p"], "neg")

    def product(a: Column, b: Column) -> Column:  # exact: products of two counts pass 64 bits
        return a.cast("decimal(18,0)") * b.cast("decimal(19,0)")
    twice = F.sum(product(F.col("pos"), 2 * F.col("before") + F.col("neg"))) - product(F.sum("pos"), 2 * F.min("before"))
    pairs = F.col("pos").cast("double") * F.col("neg")
    return x.groupBy(by).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), (twice.cast("double") / 2).alias("_won")).select(
        by, "pos", "neg", F.when(pairs > 0, F.col("_won") / pairs).alias("auc"))


def tally(scores: DataFrame, truths: DataFrame, lines: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """AUC and balanced accuracy per question over decided rows that are not stuck.

    ``scores(question, item, p, stuck)``, ``truths(question, item, truth)``,
    ``lines(question, line)``. Null unless there are enough yeses and noes.
    """
    decided = scores.filter(~F.col("stuck")).join(truths.filter("truth IS NOT NULL"), ["question", "item"])
    rows = decided.join(lines, "question").select("question", "p", "line", F.col("truth").alias("label"))
    hit = F.avg(F.when(F.col("label"), (F.col("p") >= F.col("line")).cast("int")))
    miss = F.avg(F.when(~F.col("label"), (F.col("p") < F.col("line")).cast("int")))
    bal = rows.groupBy("question").agg(((hit + miss) / 2).alias("bal"))
    x = auc(rows).join(bal, "question")
    enough = (F.col("pos") >= min_count) & (F.col("neg") >= min_count)
    return x.select("question", F.when(enough, F.col("auc")).alias("auc"), F.when(enough, F.col("bal")).alias("bal"), "pos", "neg")


def lane_agreement(rows: DataFrame, top: int = 6) -> tuple[DataFrame, DataFrame]:
    """(histogram, summary) of chosen lanes against the fact table's, over unruled rows.

    The histogram has kinds 'wrong' (the most frequent pairs) and 'unplaced'
    (rows no fact places). The summary counts right and uncertain rows and
    averages the probability given to the right lane.
    """
    x = rows.filter("ruled = ''").withColumn("want", fact_lane(F.col("facts"), F.col("plain")))
    pairs = x.groupBy("want", F.col("lane").alias("got")).agg(F.count("*").alias("n"))
    wrong = pairs.filter("want IS NOT NULL AND got <> want AND got <> 'uncertain'").orderBy(F.desc("n"), "want", "got").limit(top)
    unplaced = pairs.filter("want IS NULL")
    hist = wrong.withColumn("kind", F.lit("wrong")).unionByName(unplaced.withColumn("kind", F.lit("unplaced")))
    given = F.aggregate(F.filter("probs", lambda e: e["lane"] == F.col("want")), F.lit(0.0), lambda a, e: a + e["p"])
    placed = x.filter("want IS NOT NULL")
    summary = placed.agg(
        F.count("*").alias("scored"), F.count_if(F.col("lane") == F.col("want")).alias("right"),
        F.count_if((F.col("lane") != F.col("want")) & (F.col("lane") == "uncertain")).alias("uncertain"), F.avg(given).alias("confidence"))
    return hist.select("kind", "want", "got", "n"), summary


def _both(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Questions countable in both models."""
    b = base.filter("bal IS NOT NULL").select("question", F.col("bal").alias("b_bal"), F.col("auc").alias("b_auc"))
    t = tuned.filter("bal IS NOT NULL").select("question", F.col("bal").alias("t_bal"), F.col("auc").alias("t_auc"))
    return b.join(t, "question")


def slice_means(base: DataFrame, tuned: DataFrame, questions: DataFrame) -> DataFrame:
    """Means of both models per slice: all, by origin, taught or not. ``questions(question, origin, taught)``."""
    x = _both(base, tuned).join(questions, "question")
    slices = F.explode(F.array(F.lit("all"), F.col("origin"), F.when(F.col("taught"), "taught").otherwise("untaught"))).alias("slice")
    means = [F.round(F.avg(c), 3).alias(n) for c, n in (("b_bal", "base_bal"), ("t_bal", "tuned_bal"), ("b_auc", "base_auc"), ("t_auc", "tuned_auc"))]
    return x.select(slices, "b_bal", "t_bal", "b_auc", "t_auc").groupBy("slice").agg(F.count("*").alias("n"), *means)


PHRASING_GAIN, TOPIC_SLACK, QUESTION_SLACK, LANGUAGE_SLACK = 0.05, 0.02, 0.05, 0.03


def verdicts(base: DataFrame, tuned: DataFrame, asked: DataFrame, stuck: int) -> DataFrame:
    """The six checks a tuned model must pass, as (name, ok). ``asked(question, split, lang)``."""
    x = _both(base, tuned).join(asked, "question")
    tests = [
        ("held-out phrasings gain at least 0.05", F.col("split") == "heldout-phrasing", PHRASING_GAIN),
        ("held-out topics hold within 0.02", F.col("split") == "heldout-topic", -TOPIC_SLACK),
        ("held-out languages hold within 0.03", F.col("split") == "heldout-language", -LANGUAGE_SLACK),
        ("Turkish holds within 0.03", (F.col("lang") == "tr") & (F.col("split") != "train"), -LANGUAGE_SLACK),
    ]
    aggs = []
    for i, (_, pred, _) in enumerate(tests):
        aggs += [F.avg(F.when(pred, F.col("b_bal"))).alias(f"b{i}"), F.avg(F.when(pred, F.col("t_bal"))).alias(f"t{i}")]
    worse = F.count_if(tests[1][1] & (F.col("t_bal") < F.col("b_bal") - QUESTION_SLACK)).alias("worse")
    row = x.agg(*aggs, worse)
    out = [F.struct(F.lit(n).alias("name"), F.coalesce(F.col(f"t{i}") >= F.col(f"b{i}") + slack, F.lit(False)).alias("ok"))
           for i, (n, _, slack) in enumerate(tests)]
    out.append(F.struct(F.lit("no held-out topic question worse than base by more than 0.05").alias("name"), (F.col("worse") == 0).alias("ok")))
    out.append(F.struct(F.lit("the tuned model leaves no row stuck").alias("name"), F.lit(stuck == 0).alias("ok")))
    return row.select(F.inline(F.array(*out)))


def unseen(rows: DataFrame, trained: DataFrame) -> DataFrame:
    """Rows whose state no training row has."""
    return rows.join(trained.select("state"), "state", "left_anti")


def parity(a: DataFrame, b: DataFrame, max_gap: float = 0.02) -> DataFrame:
    """(lanes, agree, gap, ok) of two runs over (state, qid, choice, probs map; choice is null for a yes/no question)."""
    y = b.select("state", "qid", F.col("choice").alias("_c"), F.col("probs").alias("_p"))
    x = a.join(y, ["state", "qid"])
    gap = F.array_max(F.transform(F.map_entries("probs"), lambda e: F.abs(e["value"] - F.try_element_at("_p", e["key"]))))
    out = x.agg(F.count("choice").alias("lanes"), F.count_if(F.col("choice") == F.col("_c")).alias("agree"), F.coalesce(F.max(gap), F.lit(0.0)).alias("gap"))
    return out.withColumn("ok", (F.col("lanes") == F.col("agree")) & (F.col("gap") < max_gap))


def soft_ce(records: DataFrame) -> DataFrame:
    """Mean soft cross-entropy and argmax accuracy of (logits, target) arrays of doubles."""
    top = F.array_max("logits")
    lse = top + F.ln(F.aggregate(F.transform("logits", lambda z: F.exp(z - top)), F.lit(0.0), lambda a, e: a + e))
    x = records.withColumn("_lse", lse)
    ce = -F.aggregate(F.zip_with("target", "logits", lambda t, z: t * (z - F.col("_lse"))), F.lit(0.0), lambda a, e: a + e)
    right = F.array_position("logits", F.array_max("logits")) == F.array_position("target", F.array_max("target"))
    return x.select(ce.alias("ce"), right.alias("right")).agg(
        F.coalesce(F.avg("ce"), F.lit(0.0)).alias("ce"), F.coalesce(F.avg(F.col("right").cast("int")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


# ---- topic truths ---------------------------------------------------------------------------

# Topic -> how its answer is read.
#   facts: any of these facts; bridge: a bridge in this direction; protocol: this protocol (and fact);
#   amount: comparison of the amount in millionths; party: side and kind.
TOPICS = {
    "swap": ("facts", ["swap", "market"]),
    "bridge": ("facts", ["bridge"]),
    "bridge_out": ("bridge", "out"),
    "bridge_in": ("bridge", "in"),
    "over_10k": ("amount", ">=", 10_000_000_000),
    "over_100": ("amount", ">=", 100_000_000),
    "under_1": ("amount", "<", 1_000_000),
    "under_cent": ("dust", 10_000),
    "zero_amount": ("amount", "=", 0),
    "direct_payment": ("direct",),
    "to_wallet": ("party", "to", "wallet"),
    "to_contract": ("party", "to", "contract"),
    "from_wallet": ("party", "frm", "wallet"),
    "from_contract": ("party", "frm", "contract"),
    "minted": ("zero", "frm"),
    "burned": ("zero", "to"),
    "signed": ("facts", ["signed"]),
    "defi": ("facts", ["swap", "liquidity", "vault", "lending", "bridge", "market", "wrap"]),
    "vault": ("facts", ["vault"]),
    "lending": ("facts", ["lending"]),
    "wrap": ("facts", ["wrap"]),
    "cctp": ("protocol", "CCTP", ""),
    "spam": ("amount", "<", 10_000),
    "relay": ("protocol", "Relay", ""),
    "smart_account": ("facts", ["smart_account"]),
    "fee": ("facts", ["fee"]),
    "liquidity": ("facts", ["liquidity"]),
    "batch": ("facts", ["batch"]),
    "payout": ("facts", ["payout"]),
    "market": ("facts", ["market"]),
    "uniswap": ("protocol", "Uniswap", "swap"),
    "aerodrome": ("protocol", "Aerodrome", "swap"),
    "okx": ("protocol", "OKX DEX", ""),
    "kyberswap": ("protocol", "KyberSwap", ""),
    "oneinch": ("protocol", "1inch", ""),
    "lifi": ("protocol", "LI.FI", ""),
}


def _kind(address: str, kind: str) -> Column:
    return F.when(F.col(address) == V.ZERO_ADDRESS, "zero").when(F.col(kind).isNull(), "account").when(F.col(kind), "contract").otherwise("wallet")


def readings(live: DataFrame) -> DataFrame:
    """What a story says of a live row: readable, facts, value, party kinds, protocol, direction, plain."""
    bridge = F.array_contains("facts", "bridge")
    return live.withColumns({
        "readable": F.col("ctx").isNotNull(), "frm_is": _kind("from_addr", "from_kind"), "to_is": _kind("to_addr", "to_kind"),
        "protocol": F.when(F.col("protocol") == "USDC", "").otherwise(F.col("protocol")),
        "direction": F.when(bridge, F.coalesce("direction", F.lit(""))).otherwise(""),
    })


def truth(rule: tuple) -> Column:
    """One topic's answer over a reading; null when the story cannot say."""
    kind, *args = rule
    readable = F.col("readable")
    if kind == "facts":
        return F.when(readable, F.arrays_overlap("facts", F.array(*[F.lit(f) for f in args[0]])))
    if kind == "bridge":
        known = F.when(F.col("direction") != "", F.col("direction") == args[0])
        return F.when(readable, F.when(~F.array_contains("facts", "bridge"), False).otherwise(known))
    if kind == "protocol":
        hit = F.col("protocol") == args[0]
        return F.when(readable, hit & F.array_contains("facts", args[1]) if args[1] else hit)
    if kind == "amount":
        return F.expr(f"value {args[0]} {args[1]}")
    if kind == "dust":
        return F.when(F.col("value") != 0, F.col("value") < args[0])
    if kind == "zero":
        return F.col(f"{args[0]}_is") == "zero"
    if kind == "party":
        side = F.col(f"{args[0]}_is")
        return F.when(side != "account", side == args[1])
    if kind == "direct":
        known = readable & (F.col("frm_is") != "account") & (F.col("to_is") != "account")
        return F.when(known, F.col("plain") & (F.col("frm_is") == "wallet") & (F.col("to_is") == "wallet"))
    raise ValueError(kind)


def all_true(parts: list[Column]) -> Column:
    """Conjunction in which one undecided part leaves the whole undecided."""
    undecided = reduce(lambda a, b: a | b, [p.isNull() for p in parts])
    return F.when(~undecided, reduce(lambda a, b: a & b, parts))


def topic_truth(rows: DataFrame, topics: dict[str, tuple | list[tuple]], keep: list[str]) -> DataFrame:
    """One row per reading and topic; a topic given as a list is the conjunction of its rules.

    Readings repeat story by story, so callers pass distinct stories (distinct_stories).
    """
    answers = [F.struct(F.lit(t).alias("topic"), (all_true([truth(r) for r in rule]) if isinstance(rule, list) else truth(rule)).alias("truth"))
               for t, rule in topics.items()]
    return rows.select(*keep, F.inline(F.array(*answers)))
