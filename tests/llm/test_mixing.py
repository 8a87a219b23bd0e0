"""Budgets, the knapsack against enumeration, and drawn documents."""

import random
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from timberline.llm import mixing


def _best(counts, budget):
    reachable = 1
    for n, c in counts.items():
        for _ in range(c):
            reachable |= reachable << n
    return (reachable & ((1 << (budget + 1)) - 1)).bit_length() - 1


def _sum(taken):
    return sum(n * c for n, c in taken.items())


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 60))
def test_against_enumeration(counts, budget):
    taken = mixing.fit_budget(counts, budget)
    best = max(s for c in product(*[range(n + 1) for n in counts.values()]) if (s := sum(a * b for a, b in zip(c, counts))) <= budget)
    assert all(0 < c <= counts[n] for n, c in taken.items()) and _sum(taken) == best


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 900), st.integers(1, 40), min_size=1, max_size=20), st.floats(0, 1), st.sampled_from([1, 32, mixing.REACH]))
def test_every_fit_is_the_best(counts, share, start):
    budget = int(_sum(counts) * share)
    taken = mixing.fit_budget(counts, budget, start)
    assert all(0 < c <= counts[n] for n, c in taken.items()) and _sum(taken) == _best(counts, budget)


def test_long_documents_are_fitted_exactly():
    counts = {42781: 2, 79709: 2, 43932: 2, 86842: 2, 74236: 2, 82574: 1}
    assert _sum(mixing.fit_budget(counts, 505_636)) == 503_920
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randint(20_000, 90_000): rng.randint(1, 3) for _ in range(rng.randint(2, 9))}
        budget = int(_sum(counts) * rng.random())
        assert _sum(mixing.fit_budget(counts, budget)) == _best(counts, budget)
    # common divisors, and a budget far beyond what is looked at
    assert _sum(mixing.fit_budget({6: 10**9, 10: 10**9, 14: 3}, 10**9 + 1)) == 10**9


def test_no_length_is_favoured():
    counts = {n: 1 + n % 3 for n in range(1, 2000)}
    taken = mixing.fit_budget(counts, _sum(counts) // 10)
    assert _sum(taken) == _sum(counts) // 10
    for a in range(1, 2000, 200):
        part = range(a, min(a + 200, 2000))
        assert abs(sum(taken.get(n, 0) for n in part) - sum(counts[n] for n in part) / 10) < 6


SCHEMA = "doc_id long, source string, text string, times int"
GOAL = "source string, target_share double, max_repeat int"


def test_mix(spark):
    rows = [(i, "Big" if i % 3 else " small-one ", f"word {i} " * (i % 7 + 1), 0) for i in range(1, 400)]
    rows += [(1000, None, "x", 0), (1001, "big", None, 0), (1002, "big", "", 0), (1003, "other", "x", 0), (1, "Big", "word 1 " * 2, 0)]
    goal = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.4, 2), ("absent", 0.1, 4)], GOAL)
    docs = spark.createDataFrame(rows, SCHEMA)
    drawn, report = mixing.mix(docs, goal)
    d = drawn.collect()
    assert len({r["doc_id"] for r in d}) == len(d) and not {1000, 1001, 1002, 1003} & {r["doc_id"] for r in d}
    r = {x["source"]: x for x in report.collect()}
    for s, most in (("big", 1), ("small_one", 2)):
        mine = [x for x in d if x["source"] == s]
        assert max(x["times"] for x in mine) <= most
        assert sum(x["times"] * x["n_tokens"] for x in mine) == r[s]["tokens"] and r[s]["target_tokens"] - r[s]["tokens"] <= 2
        assert sum(x["times"] for x in mine) == r[s]["documents"]
    assert r["absent"]["tokens"] == 0 and abs(sum(x["share"] for x in r.values()) - 1) < 1e-9
    again = mixing.mix(docs, goal)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, d))


def test_one_length_for_a_third_of_all(spark):
    rows = [(i, "a", "same text", 0) for i in range(3000)]
    drawn, report = mixing.mix(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a", 1.0, 1)], GOAL), total=1234)
    assert report.first()["tokens"] == 1234 and drawn.count() == 617


def test_large_counts_are_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 100)
    rows = [(i, "a", "same text", 0) for i in range(3000)]
    drawn, _ = mixing.mix(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a", 1.0, 1)], GOAL), total=1234)
    assert drawn.count() == 617


def test_empty(spark):
    drawn, report = mixing.mix(spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", 1.0, None)], GOAL))
    assert drawn.count() == 0 and report.first()["tokens"] == 0
    assert mixing.mix(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], GOAL))[1].count() == 0
