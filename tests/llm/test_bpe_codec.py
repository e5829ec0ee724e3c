"""Tree concatenation against the tokenizers library on whole texts."""

import hashlib
import random

import pytest

from chainloom.llm import bpe_codec, queries

ODD = [
    None, "", " ", "\n\t \r", "a", "Hello, World!  It's 42.", "don't we'll I'VE 'sup !'s .'t", "<|endoftext|>", "x<|endoftext|>y <|startoftext|><|endoftext|>.",
    "<|ENDOFTEXT|> <|endoftext |>", "é ́a ≠ İstanbul ẞ ΑΣ Σ.", "日本語のテキスト。한글 한", "a b　c\u0085d", "naïve—café…", "\x00\x1c\x1f\x0b",
    "𝒳𝒴 👩‍👩‍👧 🏳️‍🌈", "a.b,c;d:e_f-g(h)i[j]k{l}m\"n`o~p", "</w> a</w>b",
]


def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe_codec.default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


def long_texts():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [
        "a" * 3001, "ab" * 1500 + "c", "the" * 900, "".join(rng.choice(letters) for _ in range(5000)), "".join(rng.choice("aeio") for _ in range(3000)) + ".", "!" * 2500, "!?" * 999 + "x",
        "日本語" * 500 + "é" * 301, "7" * 700, "x" * 250 + "<|endoftext|>" + "y" * 333 + "<|endoftext|>", "".join(rng.choice("ab.'1<|") for _ in range(4000)), " " * 1000,
        " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(60)), "in" * 100 + " " + "ing" * 400 + "́" * 50 + "é" * 200,
    ]


def test_encoding_equals_the_library(spark):
    t = library()
    texts = ODD + long_texts()
    docs = spark.createDataFrame([(i, x, "no") for i, x in enumerate(texts)] + [(None, "null id", "no"), (2, "id in use", "no")], "doc_id long, text string, ids string").repartition(3)
    want = {(i, tuple(t.encode(x or "", add_special_tokens=False).ids)) for i, x in [*enumerate(texts), (None, "null id"), (2, "id in use")]}
    for leaf in (64, 1000, 1 << 15):
        got = bpe_codec.encoded(docs, leaf=leaf)
        assert got.columns == ["doc_id", "ids"]
        assert {(r.doc_id, tuple(r.ids)) for r in got.collect()} == want
    assert bpe_codec.encoded(docs.limit(0)).count() == 0


def test_digests_and_decoding_equal_the_library(spark):
    t = library()
    texts = ODD + long_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    assert {r[0]: tuple(r)[1:] for r in bpe_codec.round_trip(docs, leaf=100).collect()} == want
    back = bpe_codec.decoded(bpe_codec.encoded(docs))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, x in enumerate(texts)}
    nothing = bpe_codec.decoded(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()
    assert [r.text for r in nothing] == ["", ""]


def test_joins_of_any_two_halves_are_exact():
    codec = bpe_codec.codec_of(bpe_codec.default_tokenizer())
    rng = random.Random(8)
    for _ in range(300):
        word = "".join(rng.choice(rng.choice(["ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz"])) for _ in range(rng.randrange(2, 60)))
        at = rng.randrange(1, len(word))
        for last in (True, False):
            got = codec.join(codec.encode_part(word[:at], False), codec.encode_part(word[at:], last), last)
            assert got == codec.encode_part(word, last), (word, at, last)
        parts = [codec.encode_part(word[k: k + 3], k + 3 >= len(word)) for k in range(0, len(word), 3)]
        assert codec.concatenated(parts) == codec.encode_part(word, True)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_registered_query_equals_the_library(spark, sf):
    t = library()
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op12_tree_bpe"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
