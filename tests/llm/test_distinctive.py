"""Divergence from randomness against its formula, and odd rows."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from timberline.llm import distinctive

SCHEMA = "session_id long, lineid long, eventid string, score string"


def test_scores_against_the_formula(spark):
    rows = [(1, 1, "a", "?"), (1, 2, "a", "?"), (1, 2, "a", "?"), (1, 3, "b", "?"), (2, 4, "b", "?"), (3, 5, "b", "?"), (3, 6, None, "?"), (None, 7, "a", "?"), (3, None, "a", "?"), (4, 8, " ", "?")]
    got = {(r["session_id"], r["eventid"]): r for r in distinctive.session_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "b"), (3, "b")}
    n, mean = 3, 5 / 3
    for (s, e), tf, length, df, total in (((1, "a"), 2, 3, 1, 2), ((1, "b"), 1, 3, 3, 3), ((2, "b"), 1, 1, 3, 3)):
        rate, tfn = total / n, tf * math.log2(1 + mean / length)
        score = (-math.log2(1 / (1 + rate)) - tfn * math.log2(rate / (1 + rate))) / (tfn + 1)
        r = got[(s, e)]
        assert (r["tf"], r["length"], r["df"], r["n_records"]) == (tf, length, df, n) and math.isclose(r["score"], score)
    assert [got[(1, "a")]["rank"], got[(1, "b")]["rank"]] == [1, 2]


def test_outstanding_bounds(spark):
    rows = [(s, 100 * s + i, "rare" if s == 1 and i < 3 else "common") for s in range(100) for i in range(5)]
    rows += [(s, 100 * s + 50 + i, "three") for s in (1, 2, 3) for i in range(3)]
    df = spark.createDataFrame(rows, "session_id long, lineid long, eventid string")
    got = {tuple(r) for r in distinctive.outstanding_events(df).select("session_id", "eventid").collect()}
    # three of a hundred sessions are not fewer than 3 %
    assert got == {(1, "rare")}


def test_scores_carry_the_choice(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(s, 1000 * s + i, f"own{s}" if rng.random() < 0.1 else f"e{min(int(rng.expovariate(0.05)), 80)}") for s in range(150) for i in range(rng.choice([3, 10, 60]))]
    df = spark.createDataFrame(rows, "session_id long, lineid long, eventid string")
    tf = Counter((s, e) for s, _, e in rows)
    spread = Counter(e for _, e in tf)
    for least, share in ((2, 0.03), (3, 0.2), (5, 0.9)):
        truth = {k for k, c in tf.items() if c >= least and spread[k[1]] < share * 150}
        high = {(r["session_id"], r["eventid"]) for r in distinctive.high_scores(df, "session_id", "eventid", least, str(share)).collect()}
        got = {(r["session_id"], r["eventid"]) for r in distinctive.outstanding(df, "session_id", "eventid", least, str(share)).collect()}
        assert truth and got == truth <= high and len(high) < len(tf)
    # without scores nothing is outstanding
    real = distinctive._scored
    monkeypatch.setattr(distinctive, "_scored", lambda *a: ((x := real(*a))[0].withColumn("score", F.lit(0.0)), *x[1:]))
    assert distinctive.outstanding(df, "session_id", "eventid", 3, "0.2").count() == 0


def test_empty(spark):
    assert distinctive.outstanding_events(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_session_of_a_third_of_all_rows(spark):
    rows = [(1, i, f"e{i % 7}") for i in range(3000)] + [(2 + i % 50, 10_000 + i, f"e{i % 11}") for i in range(6000)]
    df = spark.createDataFrame(rows, "session_id long, lineid long, eventid string")
    got = distinctive.session_scores(df)
    assert got.where("session_id = 1").count() == 7 and got.agg({"tf": "sum"}).first()[0] == 9000
