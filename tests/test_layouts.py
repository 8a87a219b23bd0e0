"""Log lines into entries: layouts, continuation, odd rows."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timberline.operators import layouts

SCHEMA = "lineid long, time string, content string"
TS = "2023-03-01 00:00:01"


def run(spark, rows, schema=SCHEMA, **k):
    return {r["lineid"]: r for r in layouts.log_entries(spark.createDataFrame(rows, schema), **k).collect()}


@pytest.mark.parametrize(
    ("time", "content", "expected"),
    [
        (TS, "1000 8 Trace: SessionDoor:: bade farewell", ("2023-03-01 00:00:01.000", "TRACE", "SessionDoor", "bade farewell")),
        (TS, "Warning: LinkProbe:: re-sent probe 3 ", ("2023-03-01 00:00:01.000", "WARNING", "LinkProbe", "re-sent probe 3")),
        ("[20230301-00:00:11.460]", "[ spool io] ERR Pump: a: b", ("2023-03-01 00:00:11.460", "ERROR", "Pump", "a: b")),
        ("[20230301-00:00:11.460]", "[main loop] Pump: queue 3 emptied", ("2023-03-01 00:00:11.460", "", "Pump", "queue 3 emptied")),
        ("31/May/2023:23:45:53.445 +0200", "WARN    [worker-17] Pump - x - y", ("2023-05-31 21:45:53.445", "WARNING", "Pump", "x - y")),
        ("1677628306584", "D|Pump|10050|retry 1|2", ("2023-02-28 23:51:46.584", "DEBUG", "Pump", "retry 1|2")),
        ("1677628306584", "Pump|F|lost", ("2023-02-28 23:51:46.584", "FATAL", "Pump", "lost")),
        ("1677628306584", '{"message": "a \\"b\\"", "component": "Pump", "pid": 5, "level": "NOTICE"}', ("2023-02-28 23:51:46.584", "NOTICE", "Pump", 'a "b"')),
        (None, '{"t": "2023-03-01 00:15:00.358", "sev": "I", "mod": "Pump", "text": "read"}', ("2023-03-01 00:15:00.358", "INFO", "Pump", "read")),
        (None, 'ts=2023-03-01T00:53:52.530Z lvl=notice comp=Pump msg="read sev=X to 5"', ("2023-03-01 00:53:52.530", "NOTICE", "Pump", "read sev=X to 5")),
        (None, 'msg="q 1 emptied" sev=TRC mod=Pump pid=18527 at=2023-03-06T05:00:54.024Z', ("2023-03-06 05:00:54.024", "TRACE", "Pump", "q 1 emptied")),
        (None, "2023-02-28T19:13:12.976-05:00 chunkpump[35339] <info> odd <echo>", ("2023-03-01 00:13:12.976", "INFO", "chunkpump", "odd <echo>")),
        (TS, "unknown option 0xd1 skipped", ("2023-03-01 00:00:01.000", "", "", "unknown option 0xd1 skipped")),
        (TS, "note: this:: is no head", ("2023-03-01 00:00:01.000", "", "", "note: this:: is no head")),
        (TS, "Info: Pump:: first\r\n\tsecond  \n  third", ("2023-03-01 00:00:01.000", "INFO", "Pump", "first, second, third")),
    ],
)
def test_layouts(spark, time, content, expected):
    r = run(spark, [(1, time, content)])[1]
    assert (r["ts_text"], r["level"], r["component"], r["message"]) == expected


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        ("2023-03-01 00:00:01,250 [ERROR] (Pump): lost 3", ("2023-03-01 00:00:01.250", "ERROR", "Pump", "lost 3")),
        ("2023-03-01T00:00:01Z WARN disk.cache - full: x", ("2023-03-01 00:00:01.000", "WARNING", "disk.cache", "full: x")),
        ("<info> [Pump] started", ("2023-03-01 00:00:01.000", "INFO", "Pump", "started")),
        ("Pump [debug] retry 1", ("2023-03-01 00:00:01.000", "DEBUG", "Pump", "retry 1")),
        ("17 | NOTICE | Pump | up - down", ("2023-03-01 00:00:01.000", "NOTICE", "Pump", "up - down")),
        ("(note) [Pump] no level", ("2023-03-01 00:00:01.000", "", "", "(note) [Pump] no level")),
        ("Error reading it: gone", ("2023-03-01 00:00:01.000", "", "", "Error reading it: gone")),
    ],
)
def test_layouts_that_no_form_names(spark, content, expected):
    r = run(spark, [(1, TS if not content.startswith("2023") else None, content)])[1]
    assert (r["ts_text"], r["level"], r["component"], r["message"]) == expected


def test_entries_over_many_blocks(spark, monkeypatch):
    rows = [(i, TS, f"Info: A:: e{i}") if i % 90 == 3 else (i, None, f"more {i}") for i in range(1000)]
    whole = {k: tuple(v) for k, v in run(spark, rows).items()}
    monkeypatch.setattr(layouts, "BLOCK_BITS", 4)
    monkeypatch.setattr(layouts, "TASK_BLOCKS", 3)
    assert {k: tuple(v) for k, v in run(spark, rows).items()} == whole and len(whole) == 13


def test_continuation_and_gaps(spark):
    rows = [
        (1, TS, "Info: A:: one"), (2, None, "caused by x"), (3, TS, "  indented with a time"), (4, TS, None), (5, None, " "), (6, None, "\tmore"),
        (7, TS, "Info: B:: two"), (7, TS, "Info: B:: two"), (8, None, "2023-03-01T00:00:02Z pump <info> three"),
    ]
    r = run(spark, rows)
    assert sorted(r) == [1, 7, 8]
    assert (r[1]["lineid_last"], r[1]["message"]) == (6, "one, caused by x, indented with a time, more")
    assert (r[7]["lineid_last"], r[7]["message"], r[8]["component"]) == (7, "two", "pump")


def test_odd_tables(spark):
    assert run(spark, []) == {}
    # a continuing row with nothing before it; null line numbers; columns with clashing names
    r = run(spark, [(5, None, "tail", "x", 1), (6, None, " more", "y", 2), (None, TS, "gone", "z", 3)], SCHEMA + ", block string, entry int")
    assert len(r) == 1 and (r[5]["ts_text"], r[5]["message"], r[5]["lineid_last"]) == ("", "tail, more", 6)
    long = "Info: A:: " + "word: " * 50_000
    assert run(spark, [(1, TS, long)])[1]["message"] == long[10:].strip()


def test_copies_that_differ(spark):
    r = run(spark, [(1, None, "tail"), (1, TS, "Info: A:: a"), (1, TS, "Info: A:: b"), (2, None, "more")])
    assert len(r) == 1 and r[1]["message"] == "b, more"


def test_entries_over_blocks(spark):
    n = 1 << layouts.BLOCK_BITS
    rows = [(n - 2, TS, "Info: A:: a")] + [(i, None, f"t{i}") for i in (n - 1, n, n + 1, 3 * n)] + [(3 * n + 1, TS, "Info: B:: b"), (4 * n, None, "u")]
    r = run(spark, rows)
    assert r[n - 2]["message"] == f"a, t{n - 1}, t{n}, t{n + 1}, t{3 * n}" and r[n - 2]["lineid_last"] == 3 * n
    assert r[3 * n + 1]["message"] == "b, u"


def test_message_ids(spark):
    df = spark.createDataFrame([(1, TS, "Info: A:: one")], SCHEMA)
    assert layouts.entries_found(df).first()["msg_id"] == hashlib.md5(b"one").hexdigest()[:8]


def test_signatures_are_few():
    import pyarrow as pa

    lines = [f"{w}: {c}:: {m} {k}" for w in ("Info", "Error") for c in ("A", "Bc") for m in ("read it", "x") for k in range(5)]
    assert len(set(layouts.signatures(pa.array(lines)).to_pylist())) == 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.just(TS), st.text(max_size=8)), st.one_of(st.none(), st.text(alphabet='a1 :[]{}|"=<>\t\n-T', max_size=30))), max_size=12))
def test_any_text_against_brute_force(spark, pairs):
    rows = [(i, t, c) for i, (t, c) in enumerate(pairs)]
    got = run(spark, rows)
    # who continues whom, stated plainly
    starts, owner = [], {}
    for i, t, c in rows:
        if c is None or not c.strip(layouts.BLANKS):
            continue
        if (t == TS and not c[0].isspace()) or not starts:
            starts.append(i)
        owner[i] = starts[-1]
    assert sorted(got) == sorted(set(owner.values()))
    for s in got:
        assert got[s]["lineid_last"] == max(i for i, o in owner.items() if o == s)
