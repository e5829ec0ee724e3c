"""Every source has its own queue, also two that a hash into 1,024 would put together."""

import collections
import random

from pyspark.sql import functions as F

from chainloom.llm import packing


def test_no_two_sources_share_a_queue(spark):
    slot = F.pmod(F.xxhash64(F.concat(F.lit("ss"), F.col("id").cast("string"))), F.lit(1024))
    same = spark.range(2000).groupBy(slot.alias("slot")).agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").orderBy("slot").first()
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(300)), f"s{same.a if i < 40 else same.b}") for i in range(80)] + [(80, "a b", None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)).collect()
    share = collections.defaultdict(collections.Counter)
    for r in got:
        share[r.sequence_id][r.source] += r.length
    assert len(share) > 8 and all(abs(share[s][f"s{same.a}"] - share[s][f"s{same.b}"]) <= 400 for s in sorted(share)[:-2])
    assert sum(r.length for r in got if r.source is None) == next(r.doc_tokens for r in got if r.source is None)
