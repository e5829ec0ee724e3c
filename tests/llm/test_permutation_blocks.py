"""The recall of the permutation index against brute force, on one full block and on several."""

import collections

import numpy as np
import pytest

from chainloom.llm import permutation_index


@pytest.mark.parametrize("n", [4096, 9000])
def test_recall_on_full_blocks(spark, n):
    x = np.random.default_rng(1).normal(size=(n, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in permutation_index.nearest(df, every=50).collect():
        got[r.query_id].add(r.vec_id)
    y, hits = x.astype(np.float64), 0
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s, kind="stable")[:20].tolist()) & found)
    assert len(got) == len(range(0, n, 50)) and hits >= 0.93 * 20 * len(got)
