"""Detectors: every window and every sample has a row."""

from pyspark.sql import functions as F

from timberline.config import Config
from timberline.models import detectors

SMALL = {"template": {"library_size": 8}, "windows": {"size_ms": 3000, "step_ms": 3001}}
LOG = "file_id int, sample_id int, lineid long, eventid string, content string, eventtemplate string, label int, t long"


def _log(spark):
    """Twelve files of three windows of four records; the middle windows of the last three files hold only new events."""
    r = []
    for s in range(12):
        for i in range(12):
            new = s >= 9 and 4 <= i < 8
            r.append((s, s, 12 * s + i, "new" if new else "bad" if i == 0 and s % 2 else f"e{i % 4}", "x", "x", int(new or (i == 0 and s % 2 == 1)), 1000 * (100 * s + i)))
    return spark.createDataFrame(r, LOG)


def test_windows_of_unknown_events_are_counted(spark):
    log = _log(spark)
    library = log.where("eventid <> 'new'").select("eventid").distinct()
    w = detectors.WindowDetector(Config().override(SMALL), name="tree").fit(log, library, "file_id", "t")
    r = w.evaluate(log, "file_id", "t").first()
    assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == 36 and r["tp"] + r["fn"] == 9
    # known to the vocabulary, but not seen when the idf was fitted
    w = detectors.WindowDetector(Config().override(SMALL), name="tree").fit(log.where("eventid <> 'new'"), log.select("eventid").distinct(), "file_id", "t")
    r = w.evaluate(log, "file_id", "t").first()
    assert r["tp"] + r["fn"] == 9 and r["fn"] == 3


def test_samples_without_typical_records_have_a_row(spark):
    log = _log(spark)
    kb = spark.createDataFrame([("bad", "error", True, "x")], "eventid string, severity string, contxt boolean, descpt string")
    labels = log.groupBy("sample_id").agg(F.when(F.col("sample_id") % 2 == 1, "c002").otherwise("c001").alias("class_label"))
    classes = spark.createDataFrame([("c001", "fine", None), ("c002", "broken", "N/A")], "class_label string, class_desc string, refs string")
    d = detectors.ContextClassifier(Config().override(SMALL), kb, name="logistic_multi").fit(log, labels, log.select("eventid").distinct())
    best = d.transform(log, classes).where("rank = 1").join(labels.withColumnRenamed("class_label", "truth"), "sample_id")
    assert best.count() == 12 and best.where("class_label = truth").count() == 12


def test_libraries_beyond_the_configured_size_keep_all_ids(spark):
    log = spark.createDataFrame([(s, s, 20 * s + i, f"e{i}", "x", "x", 0, 1000 * (100 * s + i)) for s in range(2) for i in range(20)], LOG)
    library = log.select("eventid").distinct()
    config = Config().override({"template": {"library_size": 8}, "sequences": {"width": 2, "top": 1}, "windows": {"size_ms": 3000, "step_ms": 3001}})
    seq = detectors.SequenceDetector(config).fit(log, library, "file_id")
    assert seq.vocabulary.where("eventid LIKE 'e%'").count() == 20
    assert seq.transform(log, "file_id").select("target").distinct().count() == 18
    win = detectors.WindowDetector(config)
    win.vocabulary = seq.vocabulary
    _, data = win.data(log, "file_id", "t", True)
    assert win.idf.count() == 20 and {len(r["features"]) for r in data.collect()} == {21}
