"""Detectors with learners that go on, networks and rules; repair in blocks; files told apart by their paths."""

import random

import pytest
from pyspark.sql import functions as F

from timberline.config import Config
from timberline.logtypes import CM
from timberline.models import detectors, incremental
from timberline.operators import heads, matrix, sequences, tools
from timberline.sources import readers, writers

LOG = "file_id int, lineid long, eventid string, content string, eventtemplate string, label int, t long"
SMALL = {"template": {"library_size": 8}, "sequences": {"width": 2, "top": 1, "hidden": 6, "epochs": 60}, "windows": {"size_ms": 3000, "step_ms": 3001}}


def _log(spark, files):
    r = []
    for s in files:
        for i in range(12):
            odd = s % 3 == 0 and i == 6
            r.append((s, 12 * s + i, "bad" if odd else f"e{i % 4}", "x", "x", int(odd), 1000 * (100 * s + i)))
    return spark.createDataFrame(r, LOG)


@pytest.mark.parametrize("name", incremental.NAMES)
def test_windows_learnt_in_batches(spark, tmp_path, name):
    library = _log(spark, range(3)).select("eventid").distinct()
    d = detectors.WindowDetector(Config().override(SMALL), name)
    for k in (0, 6):
        d = d.partial_fit(_log(spark, range(k, k + 6)), library, "file_id", "t")
        detectors.save(d, str(tmp_path / "m"))
        d = detectors.load(detectors.WindowDetector(d.config, name), spark, str(tmp_path / "m"))
    r = d.evaluate(_log(spark, range(12)), "file_id", "t").first()
    assert (r["tp"], r["fp"], r["fn"]) == (4, 0, 0)
    with pytest.raises(ValueError):
        detectors.WindowDetector(Config(), "tree").partial_fit(_log(spark, range(1)), library, "file_id", "t")


def test_network_and_rules_of_sequences(spark, tmp_path):
    log = _log(spark, [1, 2, 4, 5])
    d = detectors.SequenceDetector(Config().override(SMALL), "network").fit(log, log.select("eventid").distinct(), "file_id")
    detectors.save(d, str(tmp_path / "m"))
    d = detectors.load(detectors.SequenceDetector(d.config, "network"), spark, str(tmp_path / "m"))
    assert d.transform(log, "file_id").agg(F.sum("anomalous"), F.max("rank")).first() == (0, 1)
    kb = spark.createDataFrame([("e3", "error", True, "x")], "eventid string, severity string, contxt boolean, descpt string")
    judged = d.transform(log, "file_id", knowledge=kb)
    assert judged.where("anomalous = 1").count() == judged.where("severity = 'error'").count() == 12


def test_sparse_vectors(spark):
    cells = spark.createDataFrame([(1, 4, 2.0), (1, 0, 1.0), (2, 3, 5.0)], "k int, idx int, n double")
    x = {r["k"]: r["features"] for r in matrix.vectors(cells, spark.createDataFrame([(1,), (2,), (3,)], "k int"), ["k"], 6).collect()}
    assert x[1].indices.tolist() == [0, 4] and x[1].values.tolist() == [1.0, 2.0] and x[3].numNonzeros() == 0 and x[3].size == 6
    s = sequences.one_hot(spark.createDataFrame([([2, 0],), ([1, 1],)], "event_seq array<int>"), 3)
    assert sorted(r["features"].indices.tolist() for r in s.collect()) == [[1, 4], [2, 3]]


def test_repair_over_blocks(spark):
    rng = random.Random(8)
    library = spark.createDataFrame([("Alpha <*> done",), ("Beta <*> up",)], "eventtemplate string").withColumn("eventid", F.substring(F.md5("eventtemplate"), 1, 8))
    forms = ["LqAlpha <*> done", "CzBeta <*> up", "Lonely words", "tail of it", "Alpha <*> done"]
    rows = []
    for f in (1, 2):
        for i in range(300):
            t = rng.choice(forms)
            rows.append((f, i * rng.choice([1, 1, 30]) + i, "k" if t == forms[4] else "0", t))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "file_id int, line_no long, eventidold string, eventtemplate string")
    key = lambda x: sorted((r["file_id"], r["line_no"], r["eventtemplate"]) for r in x.collect())
    blocks = key(heads.repair_torn(df, library, CM, bits=3))
    assert blocks == key(heads.repair_torn(df, library, CM, bits=30))
    # one after the other
    want = []
    for f in (1, 2):
        held = None
        for at, (_, n, old, t) in enumerate(sorted(r for r in rows if r[0] == f)):
            if old != "0":
                want.append((f, n, t))
                continue
            if held is not None:
                want.append((f, n, held[0] + t if at - held[1] <= CM.scan_range else t))
                held = None
            elif t == "tail of it":
                want.append((f, n, t))
            elif t == "Lonely words":
                held = (t, at)
            else:
                held = (t[:2], at)
                want.append((f, n, t[2:]))
    assert blocks == sorted(want)


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for d in ("a b", "c"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.txt").write_text(f"{d} 1\n{d} 2\n")
    files = [str(tmp_path / "c" / "x.txt"), str(tmp_path / "a b" / "x.txt")]
    got = sorted(tuple(r) for r in readers.concatenated_files(spark, files).select("ordinal", "line_no", "value").collect())
    assert got == [(0, 1, "c 1"), (0, 2, "c 2"), (1, 1, "a b 1"), (1, 2, "a b 2")]


def test_tools(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("0", 4), ("0", 5), (None, 6), (None, 7)], "v string, p int")
    assert sorted((r["v"], r["copies"], r["p"]) for r in tools.duplicate_members(df, ["v"], "p").collect()) == [("a", 2, 1), ("a", 2, 2)]
    x = matrix.vectors(spark.createDataFrame([(1, 0, 2.0)], "k int, idx int, n double"), spark.createDataFrame([(1, 1)], "k int, label int"), ["k"], 3)
    vocabulary = spark.createDataFrame([("e", 0), ("0", 1), ("0", 2)], "eventid string, idx int")
    writers.write_matrix(x, vocabulary, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).first().asDict() == {"e": "2.0", "0": "0.0", "0_2": "0.0", "label": "1"}


def test_plane(spark):
    from timberline.models import estimators

    cells = spark.createDataFrame([(i, i % 2, float(1 + i)) for i in range(20)], "k int, idx int, n double")
    p = {r["k"]: (r["x"], r["y"]) for r in estimators.plane(matrix.vectors(cells, cells.select("k"), ["k"], 2), ["k"]).collect()}
    d = lambda a, b: sum((u - v) ** 2 for u, v in zip(p[a], p[b])) ** 0.5
    # two dimensions turned: distances stay
    assert abs(d(0, 2) - 2) < 1e-6 and abs(d(0, 1) - 5**0.5) < 1e-6
