"""Frequent subsequences against enumeration of all patterns."""

import random
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from timberline.llm import subsequences


def holds(seq, pattern):
    it = iter(seq)
    return all(x in it for x in pattern)


def brute(seqs, need, top, longest=5):
    items = [i for i in "abcdefgh" if need <= sum(i in s for s in seqs) < top]
    out = {}
    for k in range(1, longest + 1):
        for p in permutations(items, k):
            c = sum(holds(s, p) for s in seqs)
            if c >= need:
                out[p] = c
    return out


def mined(spark, seqs, share="0.4", top="0.9", **k):
    rows = [(i, 100 * i + j, x) for i, s in enumerate(seqs) for j, x in enumerate(s)]
    df = spark.createDataFrame(rows, "s long, o long, e string")
    r = subsequences.frequent_subsequences(df, "s", "o", "e", share, top, **k).collect()
    return {tuple(x["steps"]): (x["sequences"], x["maximal"]) for x in r}


def check(spark, seqs, **k):
    n = len(seqs)
    want = brute(seqs, max(1, -(-2 * n // 5)), 0.9 * n)
    got = mined(spark, seqs, **k)
    assert {p: c for p, (c, _) in got.items()} == want
    for p, (_, maximal) in got.items():
        assert maximal == (not any(len(q) > len(p) and holds(q, p) for q in want))


def test_random_sequences(spark):
    rng = random.Random(4)
    # blocks of two positions: patterns cross blocks
    check(spark, [[rng.choice("abcdef") for _ in range(rng.randint(1, 9))] for _ in range(25)], bits=1)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcde"), min_size=1, max_size=6), min_size=5, max_size=12))
def test_any_sequences(spark, seqs):
    check(spark, seqs)


def test_long_sequence_and_odd_rows(spark):
    rows = [(1, i, "abc"[i % 3], 0) for i in range(5000)] + [(2, 9001, "a", 0), (2, 9002, "b", 0), (2, 9002, "b", 0), (2, None, "c", 0), (2, 9003, None, 0), (2, 9004, " ", 0), (None, 9005, "c", 0)]
    df = spark.createDataFrame(rows, "session_id long, lineid long, eventid string, pattern int")
    got = {tuple(r["steps"]): r["sequences"] for r in subsequences.session_patterns(df, min_share="1", max_item_share="1.1", bits=8).collect()}
    assert got == {("a",): 2, ("b",): 2, ("a", "b"): 2}


def test_empty(spark):
    df = spark.createDataFrame([], "session_id long, lineid long, eventid string")
    assert subsequences.session_patterns(df).count() == 0
