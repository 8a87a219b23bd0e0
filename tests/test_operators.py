"""The reference's operators on hand-computed fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from timberline.functions import text, times
from timberline.logtypes import CM, FTP, cm
from timberline.operators import context, heads, islands, matrix, mining, normalise, rules, sequences, vocabulary, wash, windows


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_times_do_not_depend_on_the_zone(spark):
    t = ["2023-03-01 00:00:18", "[20230301-00:00:11.460]", "1677628306584", "31/May/2023:23:45:53.445 +0200", "2023-02-28T19:13:12.976-05:00", "2023-03-12 02:30:00", "", None, "x", "2023-13-01 00:00:00", "1677628306"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(times.utc_text(times.time_millis(F.col("t")))).collect()]
    assert got == ["2023-03-01 00:00:18.000", "2023-03-01 00:00:11.460", "2023-02-28 23:51:46.584", "2023-05-31 21:45:53.445", "2023-03-01 00:13:12.976", "2023-03-12 02:30:00.000", None, None, None, None, "2023-02-28 23:51:46.000"]


def test_tokens_keep_trailing_blanks(spark):
    df = spark.createDataFrame([("a b  ",), ("  a",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.tokens(F.col("t"))).collect()] == [["a", "b  "], ["a"], [], None]


def test_template_id_and_masks(spark):
    df = spark.createDataFrame([("Command: RETR <*>", "from 10.1.2.3:21 at 12:34:56 with 7 left aa:bb:cc:dd:ee:ff")], "a string, b string")
    assert df.select(text.template_id(F.col("a"))).first()[0] == "0d9f7273"
    assert df.select(text.mask(F.col("b"), FTP.masks)).first()[0] == "from <*> at <*> with <*> left <*>"


def test_split_apart(spark):
    df = spark.createDataFrame([("A=1 B::Cde (x) 5ms 10ms",)], "t string")
    assert df.select(text.split_apart(F.col("t"), CM.split_left, CM.split_right)).first()[0] == "A= 1 B:: Cde ( x ) 5 ms 10 ms"


def test_nested_join(spark):
    df = spark.createDataFrame([(1, 1, "A x"), (1, 2, "  b"), (1, 3, "  c"), (1, 4, "D"), (2, 1, " lost"), (2, 2, "E")], "file_id int, line_no long, body string")
    assert rows(normalise.join_nested(df), "file_id", "line_no") == [(1, 1, 3, "A x, b, c"), (1, 4, 1, "D"), (2, 2, 1, "E")]


def test_islands_over_blocks(spark):
    df = spark.createDataFrame([(g, i) for g in (1, 2) for i in range(40)], "g int, o long")
    x = islands.carried(df, "g", "o", F.when(F.col("o") % 17 == 3, F.col("o")), "c", bits=2)
    assert all(r["c"] == (None if r["o"] < 3 else r["o"] - (r["o"] - 3) % 17) for r in x.collect())
    y = islands.running_count(df, "g", "o", F.col("o") % 5 == 0, "n", bits=2)
    assert all(r["n"] == r["o"] // 5 + 1 for r in y.collect())


def test_wash_ftp(spark):
    raw = [
        "  nested at the head", "2022-06-22 14:42:50 \tnested", "2022-06-22 14:42:51 10236 1 Status: Connected", "no timestamp here", "2022-06-22 14:42:52 segsign: ",
        "2022-06-22 14:42:53 abn: 10236 1 Response: 220-Welcome you", "2022-06-22 14:42:54 c001 10236 1 Trace: CControlSocket::SendNextCommand() x=1",
    ]
    df = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(raw)], "file_id int, line_no long, value string")
    got = rows(wash.wash(df, FTP).select("line_no", "ts_text", "abnormal", "marked", "class_label", "body"), "line_no")
    assert got == [
        (3, "2022-06-22 14:42:51", False, False, None, "Status: Connected"),
        (6, "2022-06-22 14:42:53", True, True, None, "Response: 220 FTP server is ready"),
        (7, "2022-06-22 14:42:54", False, True, "c001", "Trace: CControlSocket:: SendNextCommand() x= 1"),
    ]
    n = normalise.normalise(wash.wash(df, FTP))
    assert [(r["line_no"], r["session_no"], r["label"]) for r in n.orderBy("line_no").collect()] == [(3, 0, 0), (6, 1, 1), (7, 2, 0)]


def test_records_of_washed_lines_read_the_raw_lines_once(spark):
    import random

    rng, raw, want = random.Random(8), [], []
    for f in range(4):
        n, open_, marked, label, session, seen = 0, False, False, None, 0, None
        for _ in range(150):
            # steps of up to a third of a block: labels, nested lines and sessions cross blocks
            n += rng.randint(1, 20_000)
            mark, c, body = rng.random() < 0.1, rng.choice([None, None, None, "c001", "c002"]), rng.choice(["", "", " \t", "Status: up", "Status: (x)", "  nested", "Status: Disconnected from server"] if f else ["", "  nested"])
            raw.append((f, n, f"2022-06-22 14:42:5{n % 10} {'segsign: ' * mark}{c + ' ' if c else ''}{body}"))
            open_ = open_ or body.startswith("S")
            if not open_ or not body.strip():
                marked, label = marked or mark, c or label
                continue
            marked, label, had, inherited = False, None, marked, label
            if body.startswith(" "):
                seen[-1] += 1
                seen[1].append("nested")
                continue
            session += mark or had or "Disc" in body
            seen = [(f, n, session, c or inherited), [body.replace("(x)", "( x )")], 1]
            want.append(seen)
    df = spark.createDataFrame(raw, "file_id int, line_no long, value string")
    want = [(*k, ", ".join(t), lines) for k, t, lines in want]
    got = normalise.normalise(wash.wash(df, FTP)).select("file_id", "line_no", "session_no", "class_label", "content", "lines")
    assert [tuple(r) for r in got.sort("file_id", "line_no").collect()] == want
    slim = normalise.normalise(wash.wash(df, FTP, text=False)).select("file_id", "line_no", "session_no", "class_label", "lines")
    assert [tuple(r) for r in slim.sort("file_id", "line_no").collect()] == [(*w[:4], w[5]) for w in want]
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()


def test_wash_with_a_learnt_width(spark):
    df = spark.createDataFrame([(1, 1, "12:34:56 hello"), (1, 2, "no time! hello"), (1, 3, "12:34:57 world")], "file_id int, line_no long, value string")
    assert [r[0] for r in wash.wash(df, FTP, width=9).orderBy("line_no").select("body").collect()] == ["hello", "world"]


DOWN = ["Active Downstream Channel Diagnostics:", "", "  rx id  dcid  freq", "  -----  ----  ----", "    1     2   308000000   y    y          34            4      Qam256", "   32    66   698000000   y    y          35            1    OFDM PLC", "", "* indicates currently configured", "after"]
UP = ["Active Upstream Channels:", "", "  ----  ----", "     0   101     1     0x2      18             9.000  5120000     3      y", "     8   149     1     0x2      18   63.700 - 78.450        0     5      y", "next"]


def test_cable_modem_tables():
    out = [x for x in cm.rewrite(DOWN, cm.START) if x is not None]
    assert out == [
        "DS channel status rxid 1 dcid 2 freq 308000000 qam y fec y snr 34 power 4 mod Qam256",
        "DS channel status rxid 32 dcid 66 freq 698000000 qam y fec y snr 35 power 1 mod OFDM_PLC", "* indicates currently configured", "after",
    ]
    out = [x for x in cm.rewrite([" x", "", *UP][2:], cm.START) if x is not None]
    assert out[-1] == "next"


def test_cable_modem_upstream_rows():
    assert cm.upstream_row(UP[3]) == "US channel status txid 0 ucid 101 dcid 1 rngsid 0x2 power 18 freqstart 9.000 freqend 9.000 symrate 5120000 phytype 3 txdata y"
    assert cm.upstream_row(UP[4]) == "US channel status txid 8 ucid 149 dcid 1 rngsid 0x2 power 18 freqstart 63.700 freqend 78.450 symrate 0 phytype 5 txdata y"
    assert cm.downstream_row("1 2 3") is None and cm.upstream_row("1 2 3") is None


def test_cable_modem_scan_in_blocks_equals_one_scan(spark):
    import random

    pool = [*DOWN, *UP, "Downloading LEAP image", ">>>>ChipID=0x3390", "    tap values:", "RCC->", "== Beginning initial ranging for Docsis UCID", "Using clamped minimum transmit power", "MSG PDU:", "===== Read Leap AIF Status =====", "  nested", "   Reason = x", "plain", "", ""]
    rng = random.Random(5)
    lines = [rng.choice(pool) for _ in range(300)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(lines)], "file_id int, line_no long, body string")
    got = rows(cm.scan(df, bits=4).select("line_no", "body"), "line_no")
    assert got == [(i, v) for i, v in enumerate(cm.rewrite(lines, cm.START)) if v is not None]


def test_cable_modem_scan_of_many_files_makes_no_group_of_each(spark):
    import random

    pool = [*DOWN, *UP, "Downloading LEAP image", ">>>>ChipID=0x3390", "RCC->", "MSG PDU:", "===== Read Leap AIF Status =====", "  nested", "plain", "", ""]
    rng = random.Random(6)
    files = {f: [(f * 7 + i * i, rng.choice(pool)) for i in range(1 + f % 13)] for f in range(60)}
    df = spark.createDataFrame([(f, n, v, f"{f}.{n}") for f, x in files.items() for n, v in x], "file_id int, line_no long, body string, more string")
    want = sorted((f, n, v, f"{f}.{n}") for f, x in files.items() for (n, _), v in zip(x, cm.rewrite([v for _, v in x], cm.START)) if v is not None)
    for bits in (3, 40):
        got = cm.scan(df, bits)
        assert [tuple(r) for r in got.sort("file_id", "line_no").collect()] == want
        assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_mining_merges_and_keeps_library_ids(spark):
    contents = ["Info: queue 5 left now", "Info: queue 6 left now", "Info: door a opened", "Info: door b opened", "Other line", "", None, "Info: queue 5 left now"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "lineid long, content string")
    assigned, templates = mining.mine(df, FTP)
    got = {r["eventtemplate"]: (r["occurrences"], r["eventidold"]) for r in templates.collect()}
    assert got == {"Info: queue <*> left now": (3, "0"), "Info: door <*> opened": (2, "0"), "Other line": (1, "0")}
    again = {r["eventtemplate"]: r["eventidold"] for r in mining.mine(df, FTP, templates)[1].collect()}
    ids = {r["eventtemplate"]: r["eventid"] for r in templates.collect()}
    assert again == ids
    s = {r["lineid"]: r["params"] for r in mining.structured(df, FTP, assigned).collect()}
    assert s[0] == ["5"] and s[3] == ["b"] and s[4] == []


def test_partitioned_mining_equals_one_pass(spark):
    import random

    rng = random.Random(1)
    words = ["a", "b", "c", "7", "9"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "lineid long, content string")
    got = {r["masked"]: r["eventtemplate"] for r in mining.mine(df, FTP, masked=True)[0].collect()}
    miners, of = {}, {}
    for t in dict.fromkeys(texts):
        w = t.split()
        of[t] = miners.setdefault((len(w), w[0]), mining.Miner(FTP.special)).take(w)
    assert got == {t: " ".join(c.words) for t, c in of.items()}


def test_learnt_width(spark):
    library = spark.createDataFrame([(text_id("Status: connected to <*>"),)], "eventid string")
    head = "[20190719-08:58:23.738] "
    lines = [(1, "foreign", "foreign"), (2, head + "Status: connected to x", "<*> Status: connected to <*>"), (3, head + "z", "z")]
    df = spark.createDataFrame(lines, "line_no long, content string, eventtemplate string")
    assert rows(heads.learn_width(df, library)) == [(24, 2)]
    assert rows(heads.learn_width(df.where("line_no = 1"), library)) == [(-1, None)]


def text_id(t):
    import hashlib

    return hashlib.md5(t.encode()).hexdigest()[:8]


def test_torn_records(spark):
    library = spark.createDataFrame([(text_id("Known line"),)], "eventid string")
    r = [(1, 1, "x", "Plain"), (1, 2, "0", "Loading imKnown line"), (1, 3, "x", "Plain"), (1, 4, "0", "age 1"), (1, 5, "0", "zzz"), (1, 6, "0", "Lonely"), (1, 7, "0", " end")]
    df = spark.createDataFrame(r, "file_id int, line_no long, eventidold string, eventtemplate string")
    got = rows(heads.repair_torn(df, library, CM).select("line_no", "eventtemplate"), "line_no")
    assert got == [(1, "Plain"), (2, "Known line"), (3, "Plain"), (4, "Loading image 1"), (5, "zzz"), (7, "Lonely end")]


def test_torn_records_of_many_files_make_no_group_of_each(spark):
    library = spark.createDataFrame([(text_id("Known line"),)], "eventid string")
    # the head waits over blocks that hold known records only, and is lost beyond the reach
    torn = lambda f, n: [(f, 0, "0", "Loading imKnown line"), *[(f, 9 * i, "x", "Plain") for i in range(1, n)], (f, 9 * n, "0", "age 1"), (f, 9 * n + 1, "0", "Lonely")]
    far = CM.scan_range + 1
    df = spark.createDataFrame([r for f in range(30) for r in torn(f, far if f % 2 else far - 1)], "file_id int, line_no long, eventidold string, eventtemplate string")
    want = [(f, n, {"Loading imKnown line": "Known line", "age 1": "age 1" if f % 2 else "Loading image 1"}.get(t, t)) for f in range(30) for _, n, _, t in torn(f, far if f % 2 else far - 1) if t != "Lonely"]
    for bits in (2, 40):
        got = heads.repair_torn(df, library, CM, bits=bits)
        assert rows(got.select("file_id", "line_no", "eventtemplate"), "file_id", "line_no") == want
        assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
    # a kind of log whose records are not torn
    assert sorted(heads.repair_torn(df, library, FTP).collect()) == sorted(df.collect())


def test_rules_with_parameters_and_context(spark):
    base = "file_id int, lineid long, eventid string, content string, eventtemplate string"
    t = "DS channel status rxid <*> dcid <*> freq <*> qam <*> fec <*> snr <*> power <*> mod <*>"
    c = "DS channel status rxid 1 dcid 2 freq 3 qam n fec y snr 20 power 16 mod Qam64"
    adj, rsp = "RNG-RSP UsChanId= <*> Adj: power= <*> Stat= <*>", "RNG-RSP UsChanId= <*> Stat= <*>"
    r = [(1, 1, "bd6df2e3", c, t), (1, 2, "33de59d1", "RNG-RSP UsChanId= 1 Stat= Abort", rsp), (1, 3, "b2079e76", "RNG-RSP UsChanId= 1 Adj: power= -4 Stat= Continue", adj), (1, 4, "33de59d1", "RNG-RSP UsChanId= 1 Stat= Abort", rsp), (1, 5, "none", "x", "x")]
    table = spark.createDataFrame([("none", "notice", False, "hi")], "eventid string, severity string, contxt boolean, descpt string")
    got = {x["lineid"]: x for x in rules.judged(spark.createDataFrame(r, base), table, rules.CM_RULES).collect()}
    assert got[1]["severity"] == "warning" and got[1]["advice"].count(". ") >= 3
    assert "Decrease" in got[2]["advice"] and "Increase" in got[4]["advice"] and got[3]["severity"] == "info"
    assert (got[5]["severity"], got[5]["has_context"], got[5]["advice"]) == ("notice", False, "hi")
    assert [x["number"] for x in rules.top_advice(spark.createDataFrame([y.asDict() for y in got.values()], "lineid long, severity string, advice string")).collect()] == [1, 2, 3, 4]


def test_ftp_rules(spark):
    r = [(1, 1, "8b23502c", "Response: 550 Permission denied", "Response: <*> Permission denied"), (1, 2, "52dbb961", "Response: 530 Login incorrect.", "Response: <*> Login <*>"), (1, 3, "52dbb961", "Response: 230 Login ok", "Response: <*> Login <*>")]
    table = spark.createDataFrame([], "eventid string, severity string, contxt boolean, descpt string")
    got = rules.judged(spark.createDataFrame(r, "file_id int, lineid long, eventid string, content string, eventtemplate string"), table, rules.FTP_RULES).orderBy("lineid").collect()
    assert [x["severity"] for x in got] == ["error", "error", "info"]


def test_sliding_windows(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 1, 4, 5, 9, 12)] + [("b", 7), (None, 1), ("a", 5)], "g string, t long")
    got = rows(windows.sliding_windows(df, "g", "t", 5, 3), "g", "window_no")
    assert got == [("a", 0, 0, 5), ("a", 1, 4, 9), ("a", 2, 9, 12), ("b", 0, 7, 7)]
    w = windows.sliding_windows(df, "g", "t", 5, 3)
    members = windows.window_records(df.where("g IS NOT NULL"), w, "g", "t", 5)
    assert members.where("g = 'a'").groupBy("window_no").count().orderBy("window_no").collect()[0]["count"] == 5
    with pytest.raises(ValueError):
        windows.sliding_windows(df, "g", "t", 5, 7)


def test_tf_idf(spark):
    m = spark.createDataFrame([(1, 7, 2), (2, 7, 1)], "w int, idx int, n long")
    got = matrix.tf_idf(m, matrix.idf(m, 3)).where("w = 1").first()["value"]
    assert math.isclose(got, 2 * math.log(3 / (2 + 1e-8)))


def test_context_features(spark):
    r = [(1, i, f"e{i}", "error" if i == 3 else "info", True, [] if True else None) for i in range(7)]
    df = spark.createDataFrame(r, "s int, lineid long, eventid string, severity string, has_context boolean, params array<string>")
    full = {x["eventid"]: x["value"] for x in context.count_features(df, "s", "lineid", 1).collect()}
    assert full == pytest.approx({"e3": 1 / 3 + 3, "e2": 1 / 3 + 1, "e4": 1 / 3 + 1})
    blocks = {x["eventid"]: x["value"] for x in context.count_features(df, "s", "lineid", 1, "PART", bits=1).collect()}
    assert blocks == pytest.approx(full)
    assert {x["eventid"]: x["value"] for x in context.binary_features(df, "s", "lineid", 1).collect()} == {"e3": 3.0, "e2": 1.0, "e4": 1.0}


def test_sequences_of_sessions(spark):
    sizes, r, k = [10, 8, 4, 7], [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            k += 1
            r.append((s, k, k % 3, int(k == 12)))
    df = spark.createDataFrame(r, "s int, lineid long, idx int, label int")
    for bits in (16, 1):
        got = rows(sequences.event_sequences(df, "s", "lineid", 5, "label", bits=bits).select("lineid", "label"), "lineid")
        assert [x for x, _ in got] == [6, 7, 8, 9, 10, 16, 17, 18, 28, 29]
        assert [x for x, y in got if y] == [16, 17]


def test_vocabulary(spark):
    library = spark.createDataFrame([("x", "a"), ("b", "b"), ("0", "c")], "eventidold string, eventid string")
    v = vocabulary.build(library, 6)
    got = {r["idx"]: r["eventid"] for r in v.collect()}
    assert sorted(got) == list(range(6)) and got[5] == vocabulary.UNKNOWN and sorted(x for x in got.values() if x in "abc") == ["a", "b", "c"]
    more = {r["idx"]: r["eventid"] for r in vocabulary.insert(v, spark.createDataFrame([("d",), ("e",), ("a",)], "eventid string")).collect()}
    assert all(more[i] == e for i, e in got.items() if e != "0") and sum(x in "de" for x in more.values()) == 2
    old = spark.createDataFrame([("x", 0), ("b", 1)], "eventid string, idx int")
    assert rows(vocabulary.rename(old, library), "idx") == [("a", 0), ("b", 1)]
