"""The wide table of counts, last lines and totals."""

from timberline.operators.features import event_features

SCHEMA = "session_id long, file_id int, lineid long, eventid string, content string, label int, n string"


def test_counts_last_and_totals(spark):
    rows = [
        (1, 9, 1, "aa", "xyz", 0, "?"), (1, 9, 1, "aa", "xyz", 0, "?"), (1, 9, 5, "aa", "x", 1, "?"), (1, 9, 6, "bb", None, None, "?"), (1, 9, 7, None, "12", 0, "?"),
        (2, 9, 8, "zz", "1", 0, "?"), (None, 9, 9, "aa", "1", 0, "?"), (2, None, None, "aa", "1", 0, "?"),
    ]
    library = spark.createDataFrame([("aa",), ("bb",), ("cc",), (None,), ("aa",)], "eventid string")
    r = {x["session_id"]: x.asDict() for x in event_features(spark.createDataFrame(rows, SCHEMA), library, "session_id").collect()}
    assert sorted(r) == [1, 2]
    a = r[1]
    assert (a["records"], a["events"], a["last_line"], a["chars"], a["abnormal"]) == (4, 3, 7, 6, 1)
    assert (a["n_aa"], a["last_aa"], a["chars_aa"], a["n_bb"], a["chars_bb"], a["n_cc"], a["last_cc"], a["chars_cc"]) == (2, 5, 4, 1, 0, 0, None, 0)
    assert (r[2]["records"], r[2]["events"], r[2]["n_aa"]) == (1, 0, 0)
    files = event_features(spark.createDataFrame(rows, SCHEMA), library, "file_id").collect()
    assert len(files) == 1 and files[0]["n_aa"] == 3


def test_empty(spark):
    library = spark.createDataFrame([("aa",)], "eventid string")
    assert event_features(spark.createDataFrame([], SCHEMA), library, "session_id").count() == 0


def test_many_types_in_groups(spark):
    types = [f"t{i:03d}" for i in range(50)]
    rows = [(s, 1, 1000 * s + i, types[(7 * i + s) % 50] if i % 4 else None, "x" * (i % 5), i % 2, "?") for s in range(5) for i in range(90)]
    library = spark.createDataFrame([(t,) for t in types], "eventid string")
    got = {r["session_id"]: r for r in event_features(spark.createDataFrame(rows, SCHEMA), library, "session_id").collect()}
    for s in range(5):
        mine = [r for r in rows if r[0] == s]
        assert (got[s]["records"], got[s]["events"], got[s]["chars"]) == (90, sum(r[3] is not None for r in mine), sum(len(r[4]) for r in mine))
        for t in types:
            of = [r for r in mine if r[3] == t]
            assert (got[s][f"n_{t}"], got[s][f"last_{t}"], got[s][f"chars_{t}"]) == (len(of), max((r[2] for r in of), default=None), sum(len(r[4]) for r in of))
