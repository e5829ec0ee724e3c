"""Pairs of words that are harmless alone: they must reach the machine, and only they may."""

from itertools import combinations

import numpy as np
import pyarrow as pa

from chainloom.llm import toxicity


def drawn(n, seed):
    """Two words are toxic together; alone and overall their rows are as toxic as the mean."""
    rng = np.random.default_rng(seed)
    texts, kinds = [], []
    for _ in range(n):
        words = [f"w{k}" for k in (rng.zipf(1.3, 40) - 1) % 2000]
        u = rng.random()
        if u < 0.063:
            words, kind = words + ["insulta", "groupb"], "pair"
        elif u < 0.30:
            words, kind = words + ["insulta"], ""
        elif u < 0.537:
            words, kind = words + ["groupb"], ""
        else:
            kind = "slur" if rng.random() < 0.147 / 0.463 else ""
            words += ["slurword"] * (kind == "slur")
        texts.append(" ".join(rng.permutation(words)))
        kinds.append(kind)
    return toxicity.terms(pa.array(texts)), np.array(kinds)


def test_pairs_of_harmless_words_are_learnt():
    rows, kinds = drawn(6000, 1)
    new, truth = drawn(4000, 2)
    found = toxicity.fit(rows, (kinds != "").astype(float)).score(new) >= 0.7
    assert found[truth == "pair"].mean() > 0.95 and found[truth == "slur"].mean() > 0.95
    assert found[truth == ""].mean() < 0.01


def test_paired_terms_equal_brute_force():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 40, rng.integers(0, 12))).astype(np.int32) for _ in range(600)]
    y = np.array([float((3 in r and 7 in r) or rng.random() < 0.1) for r in rows])
    p = np.full(len(rows), y.mean())
    sums = {}
    for r, left, chance, toxic in zip(rows, y - p, p, y):
        for pair in combinations(r.tolist(), 2):
            n, off, spread, missed = sums.get(pair, (0, 0.0, 0.0, 0))
            sums[pair] = (n + 1, off + left, spread + chance * (1 - chance), missed + int(toxic))
    told = {t for pair, (n, off, spread, missed) in sums.items() for t in pair
            if missed >= toxicity.MIN_DOCS and off >= toxicity.MIN_DEVIATION * np.sqrt(spread)}
    assert {3, 7} <= told
    assert set(toxicity.paired_terms(rows, y, p).tolist()) == told


def test_pairs_of_long_rows_come_in_blocks():
    long = np.arange(0, 6000, 2, dtype=np.int32)
    blocks = list(toxicity._pairs_of(long))
    whole = np.concatenate(blocks)
    assert len(blocks) > 1 and max(map(len, blocks)) <= 1 << 20 and len(np.unique(whole)) == len(whole) == 3000 * 2999 // 2
    assert [len(b) for b in toxicity._pairs_of(long[:1])] == [] and len(toxicity.paired_terms([], np.zeros(0), np.zeros(0))) == 0
