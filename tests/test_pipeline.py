"""Whole runs on made-up logs, and streams."""

from pyspark.sql import functions as F

from timberline.config import for_log_type
from timberline.logtypes import FTP
from timberline.plans import pipeline
from timberline.streaming import stream

RAW = [
    "2022-06-22 14:42:51 10236 1 Status: Connected to 10.0.0.1", "2022-06-22 14:42:52 10236 1 Response: 550 Permission denied", "2022-06-22 14:42:53 \tnested words",
    "2022-06-22 14:42:54 10236 1 Status: Connected to 10.0.0.2", "2022-06-22 14:42:55 10236 1 Response: 530 Login incorrect.",
]


def _lines(spark, raw):
    return spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(raw)], "file_id int, line_no long, value string")


def test_structure_learn_and_report(spark):
    c = for_log_type("ftp")
    trained = pipeline.structure(_lines(spark, RAW), c)
    t = {r["eventtemplate"]: r["occurrences"] for r in trained.templates.collect()}
    assert t["Status: Connected to <*>"] == 2
    assert {r["lineid"]: r["content"] for r in trained.records.collect()}[2] == "Response: 550 Permission denied, nested words"
    # the same log with another timestamp
    other = [x.replace("2022-06-22 ", "<22.06.2022> ") for x in RAW]
    library = trained.templates
    s = pipeline.structure(_lines(spark, other), c, library, learn=True)
    assert s.width == 22 and {r["eventid"] for r in s.records.collect()} <= {r["eventid"] for r in library.collect()}
    foreign = pipeline.structure(_lines(spark, ["something else"]), c, library, learn=True)
    assert foreign.records.count() == 0
    kb = spark.createDataFrame([(r["eventid"], "warning", True, "Look.") for r in library.collect() if "Login" in r["eventtemplate"]], "eventid string, severity string, contxt boolean, descpt string")
    report, advice = pipeline.expert_report(_lines(spark, other), c, library, kb)
    assert [r["severity"] for r in report.collect()] == ["warning"] and advice.first()["advice"] == "Look."


def test_mining_again_changes_nothing(spark):
    c = for_log_type("ftp")
    first = pipeline.structure(_lines(spark, RAW), c)
    again = pipeline.structure(_lines(spark, RAW), c, first.templates)
    ids = lambda s: {r["eventid"] for r in s.templates.collect()}
    assert ids(first) == ids(again)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    lines = _lines(spark, RAW)
    lines.where("line_no <= 2").coalesce(1).write.parquet(src)
    out, here = str(tmp_path / "out"), str(tmp_path / "c1")

    def arrived():
        x = stream.identified(stream.joined(stream.washed(stream.stream_lines(spark, src), FTP)), FTP)
        q = x.writeStream.format("parquet").outputMode("append").option("checkpointLocation", here).trigger(availableNow=True).start(out)
        assert q.awaitTermination(90)

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        arrived()
        lines.where("line_no > 2").coalesce(1).write.mode("append").parquet(src)
        arrived()
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {r["line_no"]: (r["lines"], r["content"]) for r in spark.read.parquet(out).collect()}
    assert got == {1: (1, "Status: Connected to 10.0.0.1"), 2: (2, "Response: 550 Permission denied, nested words"), 4: (1, "Status: Connected to 10.0.0.2")}


def test_nested_lines_after_quiet_are_kept(spark, tmp_path):
    src, out, here = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    schema = "file_id int, line_no long, ts_text string, body string"
    batches = [[(1, 1, "t", "A")], [(2, 1, "t", "X")], [(1, 2, "t", " b"), (1, 3, "t", "\tc")], [(1, 4, "t", "D")]]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
            x = stream.joined(spark.readStream.schema(schema).parquet(src), quiet_ms=1)
            q = x.writeStream.format("parquet").outputMode("append").option("checkpointLocation", here).trigger(availableNow=True).start(out)
            assert q.awaitTermination(90)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = [(r["line_no"], r["lines"], r["content"]) for r in spark.read.parquet(out).where("file_id = 1").orderBy("line_no", "content").collect()]
    assert got in ([(1, 1, "A"), (1, 2, "b, c")], [(1, 3, "A, b, c")], [(1, 1, "A"), (1, 2, "b, c"), (4, 1, "D")], [(1, 3, "A, b, c"), (4, 1, "D")])


def test_clock_windows(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.range(20).select(F.timestamp_seconds(F.col("id")).alias("ts"), F.lit("a").alias("e")).coalesce(1).write.parquet(src)
    s = spark.readStream.schema("ts timestamp, e string").parquet(src)
    q = stream.clock_window_counts(s, "ts", "e").writeStream.format("memory").queryName("clock").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert sorted(r["n"] for r in spark.table("clock").collect()) == [5, 5, 10, 10, 10]
