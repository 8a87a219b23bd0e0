"""Models: additive statistics, learning on, detectors end to end."""

import random

from pyspark.sql import functions as F

from timberline.config import Config, for_log_type
from timberline.models import bayes, detectors, estimators, linear, scores


def test_bayes_adds_up(spark):
    rng = random.Random(2)
    cells, inst = [], []
    for i in range(80):
        y = i % 2
        inst.append((i, y))
        cells += [(i, e, float(rng.randint(1, 3) + 3 * y * (e == 1))) for e in (0, 1)]
    c, n = spark.createDataFrame(cells, "k int, idx int, value double"), spark.createDataFrame(inst, "k int, label int")
    whole = bayes.statistics(c, n)
    halves = bayes.added(bayes.statistics(c.where("k < 30"), n.where("k < 30")), bayes.statistics(c.where("k >= 30"), n.where("k >= 30")))
    key = lambda df: sorted(map(tuple, df.select("label", "idx", "n", "s", "ss").collect()))
    assert key(whole) == key(halves)
    p = bayes.predicted(c, n, bayes.fitted(whole)).join(n, "k")
    assert scores.accuracy(p).first()["accuracy"] > 0.9


def test_learning_on(spark):
    rng = random.Random(3)
    rows = [([x := rng.uniform(-1, 1), y := rng.uniform(-1, 1)], int(x + y > 0)) for _ in range(300)]
    df = spark.createDataFrame(rows, "features array<double>, label int")
    for loss in ("perceptron", "hinge", "log"):
        m = linear.LinearLearner(2, loss).partial_fit(df.limit(150)).partial_fit(df)
        assert scores.accuracy(m.transform(df)).first()["accuracy"] > 0.9


def test_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (None, 0)], "label int, predicted int")
    r = scores.confusion(df).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"], r["precision"], r["recall"], r["f1"]) == (1, 1, 2, 1, 0.5, 0.5, 0.5)
    assert scores.confusion(df.limit(0)).first()["f1"] == 0


def test_config():
    c = for_log_type("ftp")
    assert c.template.library_size == 500 and c.windows.step_ms == 1000 and Config().sequences.width == 15
    try:
        c.override({"windows": {"sizes": 1}})
    except KeyError as e:
        assert "windows.sizes" in str(e)
    else:
        raise AssertionError


def _log(spark):
    r, k = [], 0
    for s in range(12):
        for i in range(12):
            k += 1
            odd = s >= 9 and i == 6
            r.append((s, s, k, "bad" if odd else f"e{i % 4}", "x", "x", int(odd), 1000 * (100 * s + i)))
    return spark.createDataFrame(r, "file_id int, sample_id int, lineid long, eventid string, content string, eventtemplate string, label int, t long")


SMALL = {"template": {"library_size": 8}, "sequences": {"width": 2, "top": 1}, "windows": {"size_ms": 3000, "step_ms": 3001}}


def test_detectors(spark):
    log = _log(spark)
    library = log.select("eventid").distinct().withColumn("eventidold", F.lit("0"))
    seq = detectors.SequenceDetector(Config().override(SMALL)).fit(log, library, "file_id")
    assert {r["target"] for r in seq.transform(log, "file_id").where("anomalous = 1").collect()}
    win = detectors.WindowDetector(Config().override(SMALL)).fit(log, library, "file_id", "t")
    assert win.evaluate(log, "file_id", "t").first()["recall"] == 1
    assert win.transform(log, "file_id", "t").count() == 3


def test_diagnosis(spark):
    log = _log(spark)
    library = log.select("eventid").distinct()
    kb = spark.createDataFrame([("bad", "error", True, "x"), ("e0", "notice", True, "y")], "eventid string, severity string, contxt boolean, descpt string")
    labels = log.groupBy("sample_id").agg(F.when(F.max("label") == 1, "c002").otherwise("c001").alias("class_label"))
    classes = spark.createDataFrame([("c001", "fine", None), ("c002", "broken", "N/A")], "class_label string, class_desc string, refs string")
    d = detectors.ContextClassifier(Config().override(SMALL), kb, name="logistic_multi").fit(log, labels, library)
    best = d.transform(log, classes).where("rank = 1").join(labels.withColumnRenamed("class_label", "truth"), "sample_id")
    assert best.where("class_label = truth").count() == 12


def test_leave_one_out(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(i, i % 2, Vectors.dense([float(i % 2), 1.0])) for i in range(6)], ["k", "label", "features"])
    assert scores.accuracy(estimators.leave_one_out(df, "tree", "k")).first()["accuracy"] == 1
