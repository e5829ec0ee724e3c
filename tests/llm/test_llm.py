"""The dealt operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chainloom.llm import decontaminate, near_dedup, packing, permutation_index, pii, quality, queries, substring_dedup, suffix_tree, toxicity, warc
from compare import check, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}" + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus(extra=()):
    """Texts with copies, near copies, nulls, empties, repeated rows and one long text."""
    rng = random.Random(5)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(60)]
    texts += [texts[3], texts[3] + " tail", None, "", " \n\t", "é ß 日本 one", "ONE two", words(rng, 30_000), texts[7].replace("w1", "w2", 1), "a b c", "A B C"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(list(texts) + list(extra))]
    return rows + [rows[5], (None, "null id text here", "en", "s0", 17), (7, "another text under an id in use", "en", "s1", 5)]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_pack_covers_every_token_once(spark):
    rows = corpus()
    got = packing.pack(spark.createDataFrame(rows, DOCS).withColumn("offset", F.lit(1))).collect()
    encoder = packing.Encoder(packing.default_tokenizer())
    want = collections.Counter()
    for r in rows:
        ids = encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want[(r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    whole = collections.Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in got if r.length == r.doc_tokens)
    assert all(want[k] >= n for k, n in whole.items())
    tokens = {r[0]: 0 for r in rows}
    for r in got:
        tokens[r.doc_id] += r.length
    need = collections.Counter()
    for (d, n, _), k in want.items():
        need[d] += n * k
    assert tokens == dict(need)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for s, pieces in by.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 2048 or s == max(by)
    assert packing.pack(empty(spark)).count() == 0


def test_pack_holds_the_target_mixture(spark):
    rows = [(i, words(random.Random(i), 300), "en", "ab"[i % 2], 0) for i in range(80)]
    got = packing.pack(spark.createDataFrame(rows, DOCS), targets={"a": 0.75, "b": 0.25}, quantum=64).collect()
    share = collections.defaultdict(lambda: collections.Counter())
    for r in got:
        share[r.sequence_id][r.source] += r.length
    half = sorted(share)[: len(share) // 2]
    assert all(abs(share[s]["a"] - 1536) <= 128 for s in half)


def test_tokenizing_in_pieces_equals_tokenizing_whole():
    rng = random.Random(3)
    parts = ["a", "B", "zé", "ß", " ", "  ", " ", " ", "\n", "\n\n", "\t", "'s", "'", ".", "!!", "|", "<|endoftext|>", "12", "日本", "😀", " ", "don't", "\r\n", "(", "%%%", "_"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000)] + ["", None]
    encoder = packing.Encoder(packing.default_tokenizer())
    ids, n = encoder.encode(pa.array(texts))
    at = 0
    for t, k in zip(texts, n):
        assert encoder.tokenizer.encode(t or "", add_special_tokens=False).ids == ids[at: at + k].tolist()
        at += k


def test_decontamination_is_exact(spark):
    rng = random.Random(9)
    items = [(i, words(rng, 25)) for i in range(12)] + [(20, "only four words here"), (21, ""), (22, None), (None, words(rng, 15)), (3, words(rng, 12))]
    cut = items[2][1].split(" ")
    extra = [" ".join(cut[3:13]), " ".join(cut[3:12]), "x ONLY, four words! here y", items[4][1] + " " + items[5][1], items[13][1], words(rng, 500) + " " + items[0][1].upper()]
    rows = corpus(extra)
    got = decontaminate.contamination(spark.createDataFrame(rows, DOCS).withColumn("n_hit", F.lit(5)), spark.createDataFrame(items, "item_id long, text string")).drop("doc").collect()
    want = []
    for r in rows:
        w = ALNUM.findall((r[1] or "").translate(LOW))
        hit, ids = set(), set()
        for i, t in items:
            v = ALNUM.findall((t or "").translate(LOW))
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p: p + n] == v[a: a + n]:
                        hit.update(range(p, p + n))
                        ids |= {str(i)} - {"None"}
        want.append((r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(spark.createDataFrame(rows, DOCS), bench).filter("contaminated").count() == 0
    assert decontaminate.contamination(empty(spark), bench).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x é" * 500
    pages = [(1, "http://a.org/x?q=1", big), (2, "https://A.org:443/x", big), (9, "a.org/x", big), (3, None, None), (4, "http://b.org", "small"), (5, "http://b.org", "small"), (None, "http://c.org/ü\r\nx", big), (9, "http://d.org", big), (6, "not a url [", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = sorted(map(tuple, warc.archive_round_trip(df).collect()), key=str)
    want = []
    for p, _, h in pages:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and p != 9
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    assert warc.url_key("http://www.Example.com:8080/a b?c=d") == "com,example,www:8080)/a%20b?c=d"


def test_warc_index_finds_only_what_is_there(spark):
    from chainloom.session import new_folder
    folder = new_folder(spark, "warc-test")
    df = spark.createDataFrame([(i, f"http://h{i % 5}.org/{i // 5}", "x" * i) for i in range(3000)], "page_id long, url string, html string")
    captures = warc.write_archives(df, folder)
    files = warc.build_index(captures, folder)
    keys = warc.index_key(captures)
    ask = keys.filter("page_id % 100 = 7").select("key").union(spark.createDataFrame([("zzz",), ("",)], "key string"))
    assert sorted(r.page_id for r in warc.lookup(ask, folder, files).collect()) == list(range(7, 3000, 100))


def test_sentence_spans_remove_later_repeats(spark):
    shared = "This passage is here twice and it is long enough to count. It has a second sentence with some more words."
    rows = [(1, "One start. " + shared + " An end.", "en", "s", 1), (2, "Other start. " + shared + "\nOther end.", "en", "s", 1), (3, "Nothing shared here at all.", "en", "s", 1), (4, None, "en", "s", 1), (5, "", "en", "s", 1)]
    got = {r.doc_id: r for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, DOCS).coalesce(1).withColumn("runs", F.lit(0))).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed == 0
    assert got[2].text == "Other start. Other end." and got[2].n_removed >= 2
    assert got[3].text == rows[2][1] and got[4].text is None and got[5].text == ""
    assert substring_dedup.repeated_spans(empty(spark)).count() == 0


def test_sentence_spans_cover_long_repeats(spark):
    rng = random.Random(2)
    passage = words(rng, 80, of=100_000)
    rows = [(i, words(rng, 40, of=100_000) + " " + passage + " " + words(rng, 40, of=100_000), "en", "s", 1) for i in range(6)]
    got = substring_dedup.repeated_spans(spark.createDataFrame(rows, DOCS)).collect()
    middle = " ".join(passage.split(" ")[15:65])
    assert sum(middle in r.text for r in got) == 1


def test_sentence_spans_follow_a_passage_to_any_offset(spark):
    rng = random.Random(3)
    lead = lambda n: " ".join(f"n{rng.randrange(10 ** 9)}" for _ in range(n))
    for size in (50, 80):
        passage = [f"Passage{i * 7919 % 10 ** 6}" for i in range(size)]
        rows = [(i, lead(n) + " " + " ".join(passage).swapcase() + " " + lead(n + i), "en", "s", 1) for i, n in enumerate((40, 41, 45, 52, 3, 64, 71))]
        rows[0] = (0, lead(40) + " " + " ".join(passage) + " " + lead(11), "en", "s", 1)
        got = {r.doc_id: r.text.split(" ") for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()}
        left = [sum(w.lower().startswith("passage") for w in got[i]) for i in range(len(rows))]
        assert left[0] == size and max(left[1:]) < size - 10
        if size == 80:
            assert not any(w.swapcase() in got[i] for i in range(1, len(rows)) for w in passage[18:51])


def labelled(spark, n=1500):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        toxic, good = rng.random() < 0.2, rng.random() < 0.8
        t = words(rng, rng.randrange(20, 80), of=150)
        if toxic:
            t += " " + " ".join(rng.choices(["idiot", "moron", "scum"], k=3))
        if not good:
            t = t.upper().replace(" ", "!! ")
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int(good), int(toxic)))
    return rows, labels, spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_classifiers_on_held_out_rows(spark, name):
    rows, labels, docs, table = labelled(spark)
    found = toxicity.toxicity(docs, table).drop("doc") if name == "toxic" else quality.quality(docs, table)
    truth = {r[0]: r[2 if name == "toxic" else 1] for r in labels}
    held = [r for r in found.collect() if r.held_out]
    assert len(held) > 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % (3 if name == "toxic" else 5) == (1 if name == "toxic" else 0)) for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    odd = spark.createDataFrame(corpus(), DOCS).withColumn("score", F.lit("x"))
    run = (lambda d, t: toxicity.toxicity(d, t)) if name == "toxic" else quality.quality
    scores = run(odd, table).select("score").collect()
    assert len(scores) == len(corpus()) and all(0 <= r[0] <= 1 for r in scores)
    assert {r[0] for r in run(odd, table.limit(0)).select("score").collect()} == {0.5}
    assert run(empty(spark), table).count() == 0


def components_of(rows):
    sets = []
    for r in rows:
        w = SPACED.findall((r[1] or "").translate(LOW))
        sets.append({tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    base = [f"t{i}" for i in range(150)]
    family = []
    for _ in range(60):  # copies with a few words changed: some pairs link, some do not
        t = list(base)
        for _ in range(rng.randrange(1, 6)):
            t[rng.randrange(150)] = f"x{rng.randrange(10_000)}"
        family.append(" ".join(t))
    rows = corpus(family)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("x")))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)
    assert got == sorted(components_of(rows), key=str)
    kept = near_dedup.one_per_group(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.count() == found.select("group").distinct().count()
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_permutation_index_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[100:400] = x[7]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(3000, None, 0), (3020, [0.0] * 32, 0), (3040, [float("nan")] * 32, 0), (3060, [None] * 32, 0), (None, [1.0] * 32, 0), (20, x[20].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for r in permutation_index.nearest(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 20))
    y, hits = x.astype(np.float64), 0
    for q, found in got.items():
        s = permutation_index.inner(y, y[q])
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(s[v] == z for _, v, z in found)
        assert [(-z, v) for _, v, z in found] == sorted((-z, v) for _, v, z in found)
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    assert permutation_index.nearest(df.limit(0)).count() == 0


def test_suffix_scores(spark):
    rng = random.Random(6)
    rows = corpus([" ".join(rng.choice(["the cat sat", "a dog ran", "on the mat"]) for _ in range(60)) for _ in range(60)])
    got = suffix_tree.suffix_scores(spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1)), context_share=1e-3, entry_share=1e-4).collect()
    count = collections.Counter()
    split = [(r[0], SPACED.findall((r[1] or "").translate(LOW)) + [None]) for r in rows]
    for d, w in split:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            count.update(w)
    n, norm = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    want = sorted((str(d), len(w), sum(count[t] > 0 for t in w), n, round(sum(math.log10((count[t] + 0.5) / norm) for t in w), 6)) for d, w in split)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    regular = [r for r in got if r.doc_id is not None and 71 <= r.doc_id < 131 and r.held_out]
    assert regular and sum(r.score for r in regular) > 0.6 * sum(r.base_score for r in regular)
    assert suffix_tree.suffix_scores(empty(spark)).count() == 0


def suffix_scores_by_hand(rows, depth, divergence=0.02):
    split = [(r[0], SPACED.findall((r[1] or "").translate(LOW)) + [None]) for r in rows]
    n = [collections.Counter() for _ in range(depth + 1)]
    for d, w in split:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            for level in range(depth + 1):
                n[level].update(tuple(w[i: i + level + 1]) for i in range(len(w) - level))
    norm = sum(n[0].values()) + 0.5 * (len(n[0]) + 1)
    states = [{} for _ in range(depth + 1)]

    def chance(before, word):
        out = (n[0][(word,)] + 0.5) / norm
        for level in range(1, min(depth, len(before)) + 1):
            context = before[len(before) - level:]
            if context in states[level]:
                known = n[level][context + (word,)]
                out = (known - 0.75) / n[level - 1][context] if known >= 2 else states[level][context] * out
        return out

    for level in range(1, depth + 1):
        after = collections.defaultdict(list)
        for run, k in n[level].items():
            if k >= 2:
                after[run[:-1]].append(((k - 0.75) / n[level - 1][run[:-1]], chance(run[1:-1], run[-1])))
        found = {}
        for context, pairs in after.items():
            rest, shorter = (max(1 - sum(x), 1e-12) for x in zip(*pairs))
            if sum(p * math.log(p / q) for p, q in pairs) + rest * math.log(rest / shorter) >= divergence:
                found[context] = rest / shorter
        states[level] = found
    return [(d, sum(math.log10(chance(tuple(w[max(0, i - depth): i]), w[i])) for i in range(len(w)))) for d, w in split]


@pytest.mark.parametrize("head_share", [5e-7, 2e-3])
def test_suffix_tree_keeps_every_repeated_run(spark, head_share):
    rng = random.Random(12)
    told = ["alpha beta gamma delta epsilon zeta eta theta", "one beta gamma delta other zeta eta iota", "q beta gamma rho"]
    extra = [words(rng, 30_000, of=20_000) for _ in range(3)] + [words(rng, 5) + " " + rng.choice(told) + " " + words(rng, 5) for _ in range(40)]
    rows = corpus(extra)
    got = suffix_tree.suffix_scores(spark.createDataFrame(rows, DOCS), head_share=head_share).collect()
    want = suffix_scores_by_hand(rows, 3)
    a, b = (sorted(((str(d), s) for d, s in x)) for x in ([(r.doc_id, r.score) for r in got], want))
    assert len(a) == len(b) and all(x[0] == y[0] and abs(x[1] - y[1]) < 1e-6 * (1 + abs(y[1])) for x, y in zip(a, b))


def test_suffix_tree_distributions_sum_to_one():
    words_ = np.sort(np.arange(1, 60, dtype=np.uint64))
    rng = np.random.default_rng(0)
    count = rng.integers(50, 500, len(words_))
    total = int(count.sum())
    tree = suffix_tree.Tree(words_, count, total, len(words_))
    tree.runs.append(np.arange(10))
    uses = count[:10]
    keys = np.sort(rng.choice(10 * len(words_), 200, replace=False))
    keys = (keys // len(words_)) << suffix_tree.SHIFT | keys % len(words_)
    n = np.maximum(2, (uses[keys >> suffix_tree.SHIFT] * 0.02)).astype(int)
    suffix_tree._settle(tree, 0, uses, keys, n, 0.0)
    unknown = 0.5 / tree.norm
    for run in range(10):
        pairs = np.stack([np.full(len(words_), run), np.arange(len(words_))], 1).reshape(-1)
        p = 10.0 ** tree.log_next(pairs)[1::2]
        known = 10.0 ** tree.passed[0][run] if not np.isnan(tree.passed[0][run]) else 1.0
        assert abs(p.sum() + known * unknown - 1) < 1e-9


TEXT = ("born 1984-02-29, 31.12.1999 and 12/25/2001 but 2023-02-30; DE89370400440532013000 GB82 WEST 1234 5698 7654 32 x 078-05-1120 "
        "4111 1111 1111 1111 +4915112345678 (212) 555-0100 999.1.1.1 8.8.8.8 A.b-C@Foo.com 1234567812345678 " + "0a" * 20)


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pseudonyms_keep_their_format(spark):
    rows = [(1, TEXT), (2, "again 4111 1111 1111 1111, a.B-c@Foo.com " + "x " * 200_000), (3, None), (4, ""), (4, ""), (None, "8.8.8.8")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_replaced", F.lit("x"))
    got = {(r.doc_id, r.text): r for r in pii.pseudonymized(df, key="k").collect()}
    text = next(r.text for r in got.values() if r.doc_id == 1)
    old, new = ([m.group(0) for m in re.finditer(pii.ANY, t)] for t in (TEXT, text))
    assert len(old) == len(new) == 15
    same = {o for o, n in zip(old, new) if o == n}
    assert same == {"2023-02-30", "999.1.1.1", "1234567812345678"}
    card = next(n for o, n in zip(old, new) if o.startswith("4111"))
    assert luhn(card.replace(" ", "")) and [len(p) for p in card.split(" ")] == [4] * 4
    assert next(r.text for r in got.values() if r.doc_id == 2).startswith("again " + card + ", ")
    iban = next(n for o, n in zip(old, new) if o.startswith("DE89"))
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert next(r for r in got.values() if r.doc_id == 3).text is None
    assert next(r for r in got.values() if r.doc_id is None).text == next(n for o, n in zip(old, new) if o == "8.8.8.8")
    other = next(r.text for r in pii.pseudonymized(df, key="other").collect() if r.doc_id == 1)
    assert other != text
    assert pii.pseudonymized(empty(spark)).count() == 0


def test_feistel_is_a_permutation(spark):
    n = spark.range(pii.DAY_LOW * pii.DAY_HIGH).withColumn("s", pii.feistel(F.col("id") % pii.DAY_LOW, F.floor(F.col("id") / pii.DAY_LOW), F.lit(pii.DAY_LOW), F.lit(pii.DAY_HIGH), "k", F.lit("t")))
    r = n.agg(F.countDistinct("s"), F.min("s.a"), F.max("s.a"), F.min("s.b"), F.max("s.b")).first()
    assert tuple(r) == (pii.DAY_LOW * pii.DAY_HIGH, 0, pii.DAY_LOW - 1, 0, pii.DAY_HIGH - 1)


def test_pseudonyms_use_no_python(spark):
    plan = pii.pseudonymized(spark.createDataFrame(corpus(), DOCS).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name):
    _, _, problem = check(spark, connect(SF), SF, name, queries.QUERIES[name], queries.ORACLE.get(name))
    assert problem == ""


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, before, SF), name)
        assert after.dtypes == docs.dtypes and 0 < after.count() <= before.count()
        if name == "personal_data":
            assert after.count() == before.count()
        else:
            assert after.exceptAll(before).isEmpty()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.select("doc_id").distinct().count() == before.count()
