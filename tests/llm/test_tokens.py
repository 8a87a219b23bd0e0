"""Ids by tree of joins against the tokenizer over whole texts, and the round trip."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.llm import tokens

BPE = tokens.ByteBpe(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")


def small(text, leaf=8):
    old, tokens.LEAF = tokens.LEAF, leaf
    try:
        return BPE.encode(text), BPE.decode(BPE.encode(text))
    finally:
        tokens.LEAF = old


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=120))
def test_any_text(text):
    assert small(text) == (BPE.encoding.encode_ordinary(text), text)


def test_texts_that_cross_seams():
    rng = random.Random(0)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "ll", "1", "é", "…", "!", "-", "😀", "日本", "'re", "　", "<|endoftext|>"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 150)))
        assert small(t) == (BPE.encoding.encode_ordinary(t), t)
    for t in ("a" * 3000, " " * 3000, "\n" * 1000 + "a", "x " * 2000):
        assert small(t) == (BPE.encoding.encode_ordinary(t), t)


def test_leaves_of_every_size_on_reviews(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r["text"]]
    texts.append("".join(texts))
    for leaf in (2, 8, 64, tokens.LEAF, 256):
        assert all(small(t, leaf)[0] == BPE.encoding.encode_ordinary(t) for t in texts)


def test_joins_in_any_order_agree():
    text = "It's 10 o'clock:  they'll  meet\n\n at the café…  " * 20
    cuts = [0, 3, 4, 40, 41, 300, 301, 302, len(text)]
    parts = lambda: [BPE.leaf(text, a, b) for a, b in zip(cuts, cuts[1:])]
    left = parts()
    while len(left) > 1:
        left[:2] = [BPE.join(text, *left[:2])]
    right = parts()
    while len(right) > 1:
        right[-2:] = [BPE.join(text, *right[-2:])]
    assert left[0].ids == right[0].ids == BPE.encoding.encode_ordinary(text)


def test_table(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = [None, "", " ", "Hello <|endoftext|> world", "Hello world", "Hello world", "naïve\r\n\r\n  x  " * 2000]
    df = spark.createDataFrame([(i, x, [0]) for i, x in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_documents(df).collect()}
    assert got[0] == got[1] == []
    assert all(got[i] == t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts))
    back = tokens.encode_documents(df).select("doc_id", tokens.texts_of(spark, F.col("ids")).alias("t"))
    assert {r["doc_id"]: r["t"] for r in back.collect()} == {i: x or "" for i, x in enumerate(texts)}
    assert tokens.encode_documents(df.limit(0)).count() == 0
