"""Ranked search against plain scoring of every document, and its oracle."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chainloom.llm import queries, sketch_search
from compare import check, connect

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return TERM.findall((t or "").translate(LOW))


def plain(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(bool(c) for _, c in counts)
    length = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus():
    rng = random.Random(11)
    common = ["the", "of", "and"]
    make = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.6)) % 900}" + rng.choice(["", ",", "."]) for _ in range(n))
    texts = [make(rng.randrange(1, 150)) for _ in range(150)] + [make(20_000), "the " * 600 + "w1", None, "", " .,!", "Éa éa ÉA 日本 w2", "W1 THE w1"]
    docs = list(enumerate(texts)) + [(3, texts[3]), (None, texts[5]), (900, texts[8]), (901, texts[8]), (902, texts[8])]
    items = [(i, " ".join(texts[i * 3].split()[:30])) for i in range(20)] + [
        (50, "the"), (51, "the the w1"), (52, None), (53, ""), (54, "nowhere at all"), (55, "éa 日本"), (None, "w2 w3"), (1, "w7 of"), (1, "w7 of")]
    return docs, items


def test_search_equals_scoring_every_document(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(t, i, "x", "y") for i, t in docs], "text string, doc_id long, score string, item_id string").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    assert rows(sketch_search.search(d, q)) == plain(docs, items)
    assert rows(sketch_search.search(d, q, k=3, leaders=1)) == plain(docs, items, 3)


def test_search_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(sketch_search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(sketch_search, "ENTRIES", 50)
    docs, items = corpus()
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(sketch_search.search(d, q)) == plain(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = corpus()
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(sketch_search.search(d.limit(0), q)) == []
    assert rows(sketch_search.search(d, q.limit(0))) == []
    assert rows(sketch_search.search(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), q)) == []


def test_bounds_hold_and_are_close():
    docs, items = corpus()
    text = [t for _, t in docs]
    counts = [Counter(terms(t)) for t in text]
    n = np.array([sum(c.values()) for c in counts])
    queries_ = sketch_search.Queries([t for _, t in items], Counter(t for c in counts for t in c), int((n > 0).sum()), int(n.sum()))
    got, sketches, _, _ = sketch_search._folded(pa.array(text, pa.string()))
    assert got.tolist() == n.tolist()
    bound, score = queries_.bounds(n, sketches), queries_.scores(n, text)
    assert (bound >= score).all()
    assert bound.sum() < 1.6 * score.sum()


@pytest.mark.parametrize("name", ["op13_sketch_search"])
def test_search_oracle(spark, name):
    sf = "/root/testdata/sf0.001"
    _, n, problem = check(spark, connect(sf), sf, name, queries.QUERIES[name], queries.ORACLE[name])
    assert not problem and n
