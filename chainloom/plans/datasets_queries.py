"""Registered queries: building the question data set."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.scoring import hash_score
from ..operators import dataset as S
from ..operators import evaluate as E
from ..operators import sentences as N
from ..session import new_folder, stored
from ..sources import archive as A
from ..sources import testdata as T
from . import frames
from .evaluation_queries import P, READINGS, TRUTHS, COMBINED, story_readings
from .oracle_views import sql, texts, values

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return add


def phrasings(spark, sf):
    """A phrasing bank: a topic per conversation, its turns the askings in three languages."""
    c = T.table(spark, sf, "conversations")
    lang = F.when(F.col("turn") % 5 == 4, "es").when(F.col("role") == "user", "en").otherwise("tr")
    x = c.select(F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("topic"), lang.alias("lang"), "turn", "text", (F.col("conv_id") % 5 == 0).alias("held_out"))
    at = F.floor(F.col("turn") / 2) - F.when(F.col("lang") == "es", 0).otherwise(F.floor((F.col("turn") + 1) / 10))
    return x.withColumn("pos", at)


@query("set1_split_phrasings", """
WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'es' WHEN role = 'user' THEN 'en' ELSE 'tr' END AS lang, conv_id % 5 = 0 AS held_out FROM conversations),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lang ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id, lang) AS n FROM p)
SELECT 't' || CAST(conv_id AS VARCHAR) AS topic, turn, lang, CASE WHEN lang = 'es' THEN 'heldout-language' WHEN held_out THEN 'heldout-topic'
  WHEN n - pos <= CASE lang WHEN 'en' THEN 2 ELSE 1 END THEN 'heldout-phrasing' ELSE 'train' END AS split FROM q""")
def set1(spark, sf):
    from pyspark.sql import Window
    # positions within a topic's language, as the bank's author would number them
    bank = phrasings(spark, sf).drop("pos").withColumn("pos", F.row_number().over(Window.partitionBy("topic", "lang").orderBy("turn")) - 1)
    return S.split_phrasings(bank).select("topic", "turn", "lang", "split")


@query("set2_distinct_stories", sql(["live"], """
SELECT story, arg_min(sentence, (block_number, log_index)) AS shape, min(sentence) = max(sentence) AS one_shape, count(*) AS copies,
  arg_min(tx_hash, (block_number, log_index)) AS tx_hash FROM live GROUP BY 1"""))
def set2(spark, sf):
    return S.distinct_stories(frames.live(spark, sf).withColumnRenamed("sentence", "shape"), "story", "shape", ["block_number", "log_index"], ["tx_hash"])


def _seeded(seed: int, *parts: str) -> str:
    return "sha1(" + " || '|' || ".join([f"'{seed}'", *parts]) + ")"


def _cap(source: str, per: int, ratio: int, floor: int) -> str:
    return f"""
cnt AS (SELECT topic, least({per}, greatest({floor}, {ratio} * least(count(*) FILTER (WHERE truth), count(*) FILTER (WHERE NOT truth)))) AS cap FROM {source} WHERE truth IS NOT NULL GROUP BY 1),
capped AS (SELECT t.topic, t.story, t.truth FROM {source} t JOIN cnt ON cnt.topic = t.topic WHERE t.truth IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY t.topic, t.truth ORDER BY {_seeded(0, 't.topic', 't.story')}, t.story) <= any_value(cap) OVER (PARTITION BY t.topic, t.truth))"""


@query("set3_cap_classes", f"""
WITH t AS (SELECT q.topic, CAST(doc_id AS VARCHAR) AS story, CASE WHEN doc_id % 17 <> 0 THEN (CASE q.topic WHEN 'good' THEN quality ELSE toxic END) = 1 END AS truth
  FROM labels, (SELECT unnest(['good', 'rude']) AS topic) q), {_cap('t', 100, 3, 10)}
SELECT topic, story, truth FROM capped""")
def set3(spark, sf):
    rows = F.inline(F.array(F.struct(F.lit("good").alias("topic"), F.col("quality").alias("y")), F.struct(F.lit("rude").alias("topic"), F.col("toxic").alias("y"))))
    x = T.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("story"), rows)
    x = x.withColumn("truth", F.when(F.col("story").cast("bigint") % 17 != 0, F.col("y") == 1)).drop("y")
    return S.cap_classes(x, per=100, ratio=3, floor=10).select("topic", "story", "truth")


def outside_questions(spark, sf):
    """Questions from outside the phrasing bank: what users asked in conversations."""
    return T.table(spark, sf, "conversations").filter("role = 'user' AND text IS NOT NULL").select("text")


_OUTSIDE = "SELECT DISTINCT text FROM conversations WHERE role = 'user' AND text IS NOT NULL"
_H32 = "CAST('0x' || substr(sha1({}), 1, 8) AS BIGINT)"


@query("set4_nonsense", f"""
WITH s AS (SELECT DISTINCT sha256(text) AS state FROM documents), r AS (SELECT state, row_number() OVER (ORDER BY state) - 1 AS at, count(*) OVER () AS n FROM s),
d AS (SELECT unnest(range(0, CAST(floor((SELECT count(*) FROM documents) * 0.05) AS BIGINT))) AS i),
q AS (SELECT text, row_number() OVER (ORDER BY text) - 1 AS at, count(*) OVER () AS n FROM ({_OUTSIDE}))
SELECT r.state, 'nonsense.' || CAST(i AS VARCHAR) AS qid, q.text, false AS yes
FROM d JOIN r ON r.at = {_H32.format("'0s|' || CAST(i AS VARCHAR)")} % r.n JOIN q ON q.at = {_H32.format("'0q|' || CAST(i AS VARCHAR)")} % q.n""")
def set4(spark, sf):
    docs = T.table(spark, sf, "documents")
    return S.add_nonsense(docs.select(F.sha2("text", 256).alias("state")), docs.count(), outside_questions(spark, sf))


@query("set5_soft_gold", f"""
SELECT doc_id, CASE WHEN quality = 1 THEN 0.95 ELSE 0.05 END::DOUBLE AS yes, CASE WHEN quality = 1 THEN 0.05 ELSE 0.95 END::DOUBLE AS no,
  round(CASE WHEN doc_id % 8 = 0 THEN 0.95 ELSE 0.05 / 7 END::DOUBLE, 9) AS swap, round(CASE WHEN doc_id % 8 = 7 THEN 0.95 ELSE 0.05 / 7 END::DOUBLE, 9) AS spam FROM labels""")
def set5(spark, sf):
    lane = F.element_at(F.array(*[F.lit(k) for k in V.LANES]), (F.col("doc_id") % 8 + 1).cast("int"))
    x = T.table(spark, sf, "labels").select("doc_id", S.noul_gold(F.col("quality") == 1).alias("g"), S.lane_gold(lane).alias("l"))
    return x.select("doc_id", F.element_at("g", "true").alias("yes"), F.element_at("g", "false").alias("no"),
                    F.round(F.element_at("l", "swap"), 9).alias("swap"), F.round(F.element_at("l", "spam"), 9).alias("spam"))


@query("set6_hash_split", f"SELECT doc_id, {_H32.format('text')} % 10 = 0 AS val FROM documents")
def set6(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", S.is_val(F.col("text")).alias("val"))


def asked(spark, sf):
    """Two labelled questions per document, replay answers for some, and a lane per shape."""
    docs = T.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("state"), F.concat_ws("-", "lang", "source").alias("shape"))
    lab = T.table(spark, sf, "labels").join(docs, "doc_id")
    rows = F.inline(F.array(
        F.struct(F.lit("good.0").alias("qid"), F.lit("is it good?").alias("text"), (F.col("quality") == 1).alias("yes")),
        F.struct(F.lit("rude.0").alias("qid"), F.lit("is it rude?").alias("text"), (F.col("toxic") == 1).alias("yes"))))
    # copies of a text may be labelled differently: the first document stands for the state
    first = lab.groupBy("state").agg(F.min_by(F.struct("shape", "quality", "toxic"), "doc_id").alias("f")).select("state", "f.*")
    replay = docs.select("state", F.inline(F.array(*[
        F.struct(F.lit(t).alias("text"), hash_score(F.concat(F.lit(t), F.col("state"))).alias("p")) for t in ("Is this a gift?", "Is this a prize?")])))
    lanes = docs.groupBy("shape").agg(F.min("doc_id").alias("d")).select(
        "shape", F.element_at(F.array(*[F.lit(k) for k in V.LANES]), (F.col("d") % 8 + 1).cast("int")).alias("lane"))
    return first.select("state", "shape", rows), lanes, replay


_GOLD = "CASE WHEN {0} THEN 0.95 ELSE 0.05 END::DOUBLE"
_ROWS = f"""
dc AS (SELECT doc_id, sha256(text) AS state, lang || '-' || source AS shape FROM documents),
f AS (SELECT state, arg_min(shape, d.doc_id) AS shape, arg_min(quality, d.doc_id) AS quality, arg_min(toxic, d.doc_id) AS toxic FROM dc d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1),
flat AS (SELECT state, shape, 'good.0' AS qid, 'is it good?' AS text, {_GOLD.format('quality = 1')} AS p, 1 AS times FROM f
  UNION ALL SELECT state, shape, 'rude.0', 'is it rude?', {_GOLD.format('toxic = 1')}, 1 FROM f
  UNION ALL SELECT f.state, f.shape, 'replay.' || CAST(r.k AS VARCHAR), r.text, {P.format("r.text || f.state")}, 1 FROM f,
    (SELECT * FROM {values([(0, 'Is this a gift?'), (1, 'Is this a prize?')], 'k', 'text')}) r),
ln AS (SELECT shape, {texts(V.LANES)}[min(doc_id) % 8 + 1] AS lane FROM dc GROUP BY 1),
val AS (SELECT shape, {_H32.format('shape')} % 10 = 0 AS val FROM (SELECT shape FROM f UNION SELECT shape FROM ln))"""


@query("set7_assemble_rows", f"""
WITH {_ROWS} SELECT CASE WHEN v.val THEN 'val' ELSE 'train' END AS split, state, qid, '{V.RULE_PREFIX}' || text AS question, 'true' AS key, round(p, 9) AS p, 1::BIGINT AS copies FROM flat JOIN val v ON v.shape = flat.shape
UNION ALL SELECT CASE WHEN v.val THEN 'val' ELSE 'train' END, ln.shape, 'lane', '{V.LANE_QUESTION}', ln.lane, 0.95, CASE WHEN v.val THEN 1 ELSE 3 END FROM ln JOIN val v ON v.shape = ln.shape""")
def set7(spark, sf):
    x = S.assemble_rows(*asked(spark, sf))
    g = F.element_at("gold", F.col("qid"))
    flat = x.select("split", "state", F.explode("questions").alias("qid", "question"), "gold").withColumn("g", g)
    top = F.element_at(F.array_sort(F.transform(F.map_entries("g"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), 1)["k"]
    key = F.when(F.col("qid") == "lane", top).otherwise("true")
    flat = flat.select("split", "state", "qid", "question", key.alias("key"), F.round(F.element_at("g", key), 9).alias("p"))
    return flat.groupBy(*flat.columns).agg(F.count("*").alias("copies"))


@query("set8_row_stats", f"""
WITH {_ROWS}, e AS (SELECT CASE WHEN v.val THEN 'val' ELSE 'train' END AS split, state, qid, p, v.val FROM flat JOIN val v ON v.shape = flat.shape),
l AS (SELECT CASE WHEN v.val THEN 'val' ELSE 'train' END AS split, lane, CASE WHEN v.val THEN 1 ELSE 3 END AS times FROM ln JOIN val v ON v.shape = ln.shape),
c AS (SELECT split, 'topic:' || split_part(qid, '.', 1) || ':' || CASE WHEN p > 0.5 THEN 'yes' ELSE 'no' END AS key, count(*) AS n FROM e WHERE qid NOT LIKE 'replay%' GROUP BY ALL
  UNION ALL SELECT split, 'lane:' || lane, sum(times) FROM l GROUP BY ALL)
SELECT split, key, CAST(n AS BIGINT) AS n FROM c UNION ALL SELECT split, 'questions', CAST(sum(n) AS BIGINT) FROM c GROUP BY 1
UNION ALL SELECT split, 'rows', CAST(sum(n) AS BIGINT) FROM (SELECT split, count(DISTINCT state) AS n FROM e GROUP BY 1 UNION ALL SELECT split, sum(times) FROM l GROUP BY 1) GROUP BY 1""")
def set8(spark, sf):
    return S.row_stats(stored(S.assemble_rows(*asked(spark, sf)), "rows"))


@query("set9_audit_sample", f"""
WITH {_ROWS} SELECT state, qid, text AS question, p > 1 - p AS yes FROM flat JOIN val v ON v.shape = flat.shape WHERE NOT v.val
ORDER BY {_seeded(0, 'state', 'qid')}, state, qid LIMIT 60""")
def set9(spark, sf):
    return S.audit_sample(S.assemble_rows(*asked(spark, sf)))


@query("set10_leaks", r"""
WITH l AS (SELECT doc_id AS id, 0 AS kind, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
  UNION ALL SELECT item_id, 1, '  ' || upper(replace(text, ' ', '   ')) || '?!', 0 FROM benchmark WHERE item_id % 2 = 0),
n AS (SELECT id, kind, pos, text, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '^\s+|\s+$', '', 'g'), '[?!.？！。]+$', ''), '\s+', ' ', 'g')) AS n FROM l),
b AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '^\s+|\s+$', '', 'g'), '[?!.？！。]+$', ''), '\s+', ' ', 'g')) AS n FROM benchmark)
SELECT id, kind, CAST(pos AS INTEGER) AS pos, n.n IN (SELECT n FROM b) AS leaked, len(list_filter((SELECT list(DISTINCT w) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)), lambda w: contains(lower(text), w))) > 0 AS avoided FROM n""")
def set10(spark, sf):
    """Every line of every document, and benchmark texts in other spelling, against the benchmark and the words of part names."""
    lines = T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("kind"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    b = T.table(spark, sf, "benchmark")
    shouted = b.filter("item_id % 2 = 0").select(F.col("item_id").alias("id"), F.lit(1).alias("kind"), F.lit(0).alias("pos"),
                                                 F.concat(F.lit("  "), F.upper(F.regexp_replace("text", " ", "   ")), F.lit("?!")).alias("text"))
    words = T.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return S.leaks(lines.unionByName(shouted), b.select("text"), words).select("id", "kind", "pos", "leaked", "avoided")


def replay_scorer(question: str, stories: list[str]) -> list[float]:
    import hashlib
    return [int(hashlib.sha1((question + s).encode()).hexdigest()[:8], 16) % 10000 / 10000.0 for s in stories]


@query("set11_replay_sample", f"""
WITH s AS (SELECT DISTINCT sha256(text) AS story FROM documents),
q AS (SELECT text AS question, row_number() OVER (ORDER BY {_seeded(0, 'text')}, text) - 1 AS at, count(*) OVER () AS n FROM ({_OUTSIDE})),
r AS (SELECT story, j, (SELECT count(*) FROM q) AS n FROM s, (SELECT unnest(range(0, 6)) AS j))
SELECT story, question, {P.format('question || story')} AS p FROM r JOIN q ON q.at = ({_H32.format("'0r|' || story")} + j * greatest(1, r.n // 6)) % r.n WHERE j < r.n""")
def set11(spark, sf):
    stories = T.table(spark, sf, "documents").select(F.sha2("text", 256).alias("story")).distinct()
    return S.replay_answers(S.replay_sample(stories, outside_questions(spark, sf)), replay_scorer)


def recipe_cases() -> list[tuple]:
    """The fixed cases once more, written for the oracle: (n, recipe, selector, frm, dst, value, readable)."""
    out, n = [], 0
    for name, selector, _, _, _, mint, burn, readable in S.RECIPES:
        for frm, dst in S.MINT_PAIRS if mint else S.BURN_PAIRS if burn else S.PAIRS:
            for value in S.AMOUNTS:
                n += 1
                out.append((n, name, selector, frm, dst, value, readable))
    return out


def _addr(kind: str, slot: int) -> str:
    return (f"CASE {kind} WHEN 'zero' THEN '{V.ZERO_ADDRESS}' WHEN 'wallet' THEN '0xa{slot}' || lpad(CAST(s_suppkey AS VARCHAR), 38, '0') "
            f"ELSE '0xc{slot}' || lpad(CAST(s_suppkey AS VARCHAR), 38, '0') END")


@query("set12_recipes", f"""
SELECT s_suppkey, c.n, c.recipe, {_addr('c.frm', 0)} AS from_addr, {_addr('c.dst', 1)} AS to_addr, CAST(c.value AS VARCHAR) AS value,
  CASE WHEN c.readable THEN c.selector END AS selector, '0x' || lpad(lower(to_hex(c.n)), 64, '0') AS tx_hash
FROM supplier, (SELECT * FROM {values(recipe_cases(), 'n', 'recipe', 'selector', 'frm', 'dst', 'value', 'readable')}) c""")
def set12(spark, sf):
    """A party set per supplier."""
    k = F.col("s_suppkey")
    parties = T.table(spark, sf, "supplier").select("s_suppkey", T.padded("0xa0", k, 38).alias("wallet0"), T.padded("0xa1", k, 38).alias("wallet1"),
                                                    T.padded("0xc0", k, 38).alias("contract0"), T.padded("0xc1", k, 38).alias("contract1"))
    x = S.expand_recipes(parties)
    return x.select("s_suppkey", F.col("n").cast("int").alias("n"), "recipe", "from_addr", "to_addr", F.col("value").cast("string").alias("value"), "ctx.selector", "tx_hash")


@query("set13_distinct_cases", sql(["live"], """
SELECT sentence, ruled, array_to_string(facts, ',') AS facts, protocol, arg_min(tx_hash, (block_number, log_index)) AS tx_hash, min((block_number, log_index))[1] AS block_number
FROM live GROUP BY sentence, ruled, facts, protocol"""))
def set13(spark, sf):
    x = S.distinct_cases(frames.live(spark, sf), ["sentence", "ruled", "facts", "protocol"], ["block_number", "log_index"], ["tx_hash", "block_number"])
    return x.withColumn("facts", F.array_join("facts", ","))


@query("snk7_training_rows", f"""
WITH {_ROWS} SELECT CASE WHEN v.val THEN 'val' ELSE 'train' END AS split, state, qid, '{V.RULE_PREFIX}' || text AS question, 'true' AS key, round(p, 9) AS p, 1::BIGINT AS copies FROM flat JOIN val v ON v.shape = flat.shape
UNION ALL SELECT CASE WHEN v.val THEN 'val' ELSE 'train' END, ln.shape, 'lane', '{V.LANE_QUESTION}', k, round(CASE WHEN k = ln.lane THEN 0.95 ELSE 0.05 / 7 END::DOUBLE, 9), CASE WHEN v.val THEN 1 ELSE 3 END
FROM ln JOIN val v ON v.shape = ln.shape, (SELECT unnest({texts(V.LANES)}) AS k) l
UNION ALL SELECT CASE WHEN v.val THEN 'val' ELSE 'train' END, state, qid, '{V.RULE_PREFIX}' || text, 'false', round(1 - p, 9), 1 FROM flat JOIN val v ON v.shape = flat.shape""")
def snk7(spark, sf):
    """Every question and gold answer of the written rows, read back; the labelled documents stand for stories."""
    rows = S.assemble_rows(*asked(spark, sf))
    path = new_folder(spark, "rows")
    A.write_rows(rows, path)
    back = spark.read.schema("state string, questions map<string,string>, gold map<string,map<string,double>>, split string").json(path)
    flat = back.select("split", "state", F.explode("questions").alias("qid", "question"), "gold")
    flat = flat.select("split", "state", "qid", "question", F.explode(F.element_at("gold", F.col("qid"))).alias("key", "p"))
    return flat.groupBy("split", "state", "qid", "question", "key", F.round("p", 9).alias("p")).agg(F.count("*").alias("copies"))


@query("set3_story_questions", sql(["live"], f"""
WITH {READINGS}, t AS ({TRUTHS}), {_cap('t', 40, 3, 5)}, bank AS (SELECT unnest(['Is it so?', 'Would one say so?', 'Does it look so?', 'Was it so?']) AS text)
SELECT c.topic, c.story, c.truth, c.topic || '.' || CAST(k - 1 AS VARCHAR) AS qid, text FROM (
  SELECT capped.*, bank.text, row_number() OVER (PARTITION BY topic, story ORDER BY {_seeded(0, 'topic', 'story', 'text')}) AS k FROM capped, bank) c WHERE k <= 2"""))
def set3b(spark, sf):
    """Truths of all topics over distinct stories, capped per answer, two phrasings each."""
    truths = E.topic_truth(story_readings(spark, sf), {**E.TOPICS, **COMBINED}, ["story"])
    chosen = S.cap_classes(truths, per=40, ratio=3, floor=5)
    texts_ = F.explode(F.array(*[F.lit(t) for t in ("Is it so?", "Would one say so?", "Does it look so?", "Was it so?")])).alias("text")
    bank = truths.select("topic").distinct().select("topic", F.lit("train").alias("split"), texts_)
    return S.pick_phrasings(chosen, bank).select("topic", "story", "truth", "qid", "text")
