"""The suffix tree's counts travel as arrays of a bucket, in little memory, and the number of buckets changes no score."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from chainloom.llm import suffix_tree

MOST_MB = 200


def test_counting_holds_little_and_yields_few_rows():
    rng, names = np.random.default_rng(0), np.array([f"w{i}" for i in range(5000)])
    texts = (pa.RecordBatch.from_arrays([pa.array([" ".join(names[rng.integers(0, 5000, 100_000)])])], ["text"]) for _ in range(60))
    full, buckets = np.full(1 << 16, 255, np.uint8), 16
    tracemalloc.start()
    try:
        rows = runs = 0
        for b in suffix_tree._longer(1, full, buckets)(texts):
            rows += b.num_rows
            runs += sum(len(x) for x in b.column("n"))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert runs > 4_000_000 and rows <= buckets * (6_000_000 // suffix_tree.CHUNK + 1)  # one row a run before
    assert peak < MOST_MB  # 453 MB before


def test_many_buckets_give_the_scores_of_one(spark, monkeypatch):
    rng = random.Random(3)
    told = ["alpha beta gamma delta epsilon", "other beta gamma zeta", "beta gamma rho"]
    rows = [(i, " ".join(rng.choice(told + [f"w{rng.randrange(300)}"]) for _ in range(40))) for i in range(80)]
    rows += [rows[3], rows[3], (3, "alpha beta"), (None, rows[4][1]), (None, None), (90, ""), (91, None), (91, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for size in (1 << 24, 300):
        monkeypatch.setattr(suffix_tree, "BUCKET", size)
        got = suffix_tree.suffix_scores(df, head_share=2e-2).collect()
        found.append(sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got))
    assert len(found[0]) == len(rows) and found[0] == found[1]
