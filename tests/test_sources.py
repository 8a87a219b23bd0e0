"""Readers and writers."""

from timberline.sources import readers, writers


def test_numbered_lines_of_small_splits(spark, tmp_path):
    text = "\n".join(f"line {i}" for i in range(2000)) + "\n"
    (tmp_path / "b.txt").write_text("﻿first\r\nsecond\n")
    (tmp_path / "a.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        x = readers.numbered_lines(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = sorted((r["line_no"], r["value"]) for r in x if r["file"].endswith("a.txt"))
    assert a == [(i + 1, f"line {i}") for i in range(2000)]
    assert sorted((r["line_no"], r["value"]) for r in x if r["file"].endswith("b.txt")) == [(1, "first"), (2, "second")]


def test_folders_and_classes(spark, tmp_path):
    for c, n in (("c001", "002"), ("c001", "001"), ("c002", "009")):
        (tmp_path / c).mkdir(exist_ok=True)
        (tmp_path / c / f"x_{n}.txt").write_text("a\nb\n")
    (tmp_path / "skip.me").write_text("z")
    x = readers.folder_files(spark, str(tmp_path), skip=("skip.me",))
    got = sorted({(r["class_label"], r["file"][-7:-4], r["sample_no"]) for r in readers.with_classes(x).collect()})
    assert got == [("c001", "001", 1), ("c001", "002", 2), ("c002", "009", 1)]
    assert readers.with_session_starts(x).where("session_start").count() == 3


def test_concatenated_files_keep_list_order(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.txt").write_text(f"{n}1\n{n}2\n")
    x = readers.concatenated_files(spark, [str(tmp_path / "b.txt"), str(tmp_path / "a.txt")])
    assert [r["value"] for r in x.orderBy("ordinal", "line_no").collect()] == ["b1", "b2", "a1", "a2"]


def test_side_tables(spark, tmp_path):
    (tmp_path / "lib.csv").write_text('EventIdOld,EventId,EventTemplate\n0,aa,"x ""y"", <*> "\nNA,bb,null\n')
    got = [tuple(r) for r in readers.template_library(spark, str(tmp_path / "lib.csv")).collect()]
    assert got == [("0", "aa", 'x "y", <*> '), ("NA", "bb", "null")]
    (tmp_path / "kb.yaml").write_text("aa:\n  severity: error\n  contxt: true\n  descpt: Do it.\n")
    assert [tuple(r) for r in readers.knowledge_base(spark, str(tmp_path / "kb.yaml")).collect()] == [("aa", "error", True, "Do it.")]
    (tmp_path / "c.yaml").write_text("c001:\n  desc: d\n  refs: N/A\n")
    assert readers.class_table(spark, str(tmp_path / "c.yaml")).first()["class_desc"] == "d"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("0", "aa", "t ")], "eventidold string, eventid string, eventtemplate string")
    writers.write_library(df, str(tmp_path / "lib"), "1")
    writers.write_library(df.withColumnRenamed("eventid", "eventid"), str(tmp_path / "lib"), "2")
    assert writers.latest_library(spark, str(tmp_path / "lib")).count() == 1
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "k int, value string")
    writers.write_lines(lines, str(tmp_path / "out"), ["k"])
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b"]
    writers.write_report(lines, str(tmp_path / "rep"))
    assert spark.read.csv(str(tmp_path / "rep"), header=True).count() == 2 and "a" in writers.as_text(lines)
