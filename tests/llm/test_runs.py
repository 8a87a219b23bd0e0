"""Runs against one plain pass."""

import random

from timberline.llm import runs

SCHEMA = "session_id long, lineid long, eventid string, eventtemplate string, time string, first int, n int"


def brute(rows):
    import re

    say = lambda t: re.sub(r"[^\w\x01]|_", "", t.lower().replace("<*>", "\x01")) if t else None
    by = {}
    for s, o, e, t, *_ in rows:
        if s is not None and o is not None and e and e.strip():
            by.setdefault(s, {})[o] = (e, say(t))
    out = set()
    for s, d in by.items():
        run = []
        for o in sorted(d):
            if run and (d[o][0] == d[run[-1]][0] or (d[o][1] and d[o][1] == d[run[-1]][1])):
                run.append(o)
            else:
                if len(run) > 1:
                    out.add((s, run[0], run[-1], len(run)))
                run = [o]
        if len(run) > 1:
            out.add((s, run[0], run[-1], len(run)))
    return out


def check(spark, rows, **k):
    r = runs.runs(runs.session_events(spark.createDataFrame(rows, SCHEMA)), **k)
    assert {(x["sequence"], x["first"], x["last"], x["n"]) for x in r.collect()} == brute(rows)


def test_random_sessions_in_small_blocks(spark):
    rng = random.Random(6)
    kinds = [("a", "Pump stalled, <*> left"), ("b", "pump stalled - <*> left "), ("c", "other"), ("d", None), ("d", None), (None, None), (" ", "x"), ("e", "Other!")]
    rows, o = [], 0
    for s in range(12):
        for _ in range(rng.randint(1, 40)):
            o += 1
            e, t = rng.choice(kinds[:2] if rng.random() < 0.7 else kinds)
            rows.append((s if rng.random() < 0.98 else None, o, e, t, "2023-01-01 00:00:01", 0, 0))
    check(spark, rows + rows[::5], bits=2)
    check(spark, rows)


def test_one_long_run(spark):
    check(spark, [(1, i, "a", "x", None, 0, 0) for i in range(1000)] + [(2, 2000, "a", "x", None, 0, 0)], bits=5)


def test_durations_and_all_events(spark):
    rows = [(1, 1, "a", "x", "2023-01-01 00:00:05", 0, 0), (1, 2, None, None, None, 0, 0), (1, 3, "a", "x", "2023-01-01 00:00:02", 0, 0), (1, 4, "b", "y", None, 0, 0), (1, 5, "a", "x", "2023-01-01 00:00:09", 0, 0), (1, 5, "a", "x", "2023-01-01 00:00:09", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in runs.session_runs(df).collect()] == [(1, 1, 3, 2, 3000)]
    got = sorted(tuple(r) for r in runs.collapsed_sessions(df).collect())
    assert got == [(1, 1, 3, "a", 2, 3000), (1, 4, 4, "b", 1, None), (1, 5, 5, "a", 1, 0)]


def test_wildcards_and_empty(spark):
    check(spark, [(1, 1, "a", "left <*>", None, 0, 0), (1, 2, "b", "left", None, 0, 0), (1, 3, "c", "<*>", None, 0, 0), (1, 4, "d", "!!", None, 0, 0), (1, 5, "e", "??", None, 0, 0)])
    check(spark, [])
