"""Reading logs and side tables. Order is always a column: lines carry their file's ordinal and their number."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.operators.islands import running_sum
from timberline.plans.shared import block_of, join_counted


def numbered_lines(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """Lines of text files: file, line_no (from 1), value; without byte order marks and carriage returns.

    Splits of a file are numbered on their own and shifted by the lines before them, so a file of any size is read
    in parallel.
    """
    x = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(paths)
    x = x.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    counts = x.groupBy("file", "split").agg(F.count(F.lit(1)).alias("lines"))
    w = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file", "split", F.coalesce(F.sum("lines").over(w), F.lit(0)).alias("ahead"))
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("file", "split").orderBy("at"))).join(counts, ["file", "split"])
    return x.select("file", (F.col("ahead") + F.col("k")).alias("line_no"), F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r$", "").alias("value"))


def exploded_lines(df: DataFrame, key: str, text: str, key_as: str = "file_id") -> DataFrame:
    """The lines of texts held in rows: key, line_no (from 1), value."""
    parts = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^﻿", ""), "\r?\n", -1)
    x = df.select(F.col(key).alias(key_as), F.posexplode(parts).alias("k", "value"))
    return x.select(key_as, (F.col("k") + 1).cast("long").alias("line_no"), "value")


def concatenated(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Tables one after the other, in the order given: source_no, line_id (from 1 over all) and the columns.

    ``order``: a whole number last, before it columns of few values. Line ids come from counts per table and block, not
    from one sort of everything.
    """
    x = None
    for k, p in enumerate(parts):
        p = p.withColumn("source_no", F.lit(k))
        x = p if x is None else x.unionByName(p)
    # blocks of the last order column, a number; the columns before it, if any, order tables of few values
    *above, last = order
    x = x.withColumn("_part", block_of(F.col(last), 16))
    per = x.groupBy("source_no", *above, "_part").agg(F.count(F.lit(1)).alias("n"))
    tables = per.groupBy("source_no", *above).agg(F.sum("n").alias("rows"))
    w = Window.orderBy("source_no", *above).rowsBetween(Window.unboundedPreceding, -1)
    tables = tables.select("source_no", *above, F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("earlier"))
    per = running_sum(per.withColumn("_group", F.struct("source_no", *above)), "_group", "_part", F.col("n"), "upto").join(tables, ["source_no", *above])
    per = per.select("source_no", *above, "_part", (F.col("earlier") + F.col("upto") - F.col("n")).alias("ahead"))
    inner = F.row_number().over(Window.partitionBy("source_no", *above, "_part").orderBy(last))
    return x.withColumn("k", inner).join(per, ["source_no", *above, "_part"]).withColumn("line_id", F.col("k") + F.col("ahead")).drop("k", "ahead", "_part")


#: What comes before the path of a file's address.
_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?"


def concatenated_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """Files in list order: ordinal, file, line_no, value. Files are told apart by their whole paths."""
    lines = numbered_lines(spark, files).withColumn("path", F.url_decode(F.regexp_replace(F.regexp_replace("file", _SCHEME, ""), r"\+", "%2B")))
    places = spark.createDataFrame([(i, re.sub(_SCHEME, "", f)) for i, f in enumerate(files)], "ordinal int, path string")
    return join_counted(lines, places, ["path"], rows=len(files)).select("ordinal", "file", "line_no", "value")


def with_sample_first(lines: DataFrame, sample: DataFrame) -> DataFrame:
    """A curated sample (line_no, value) before the lines (file_id, line_no, value), as file -1: mining meets it first."""
    return sample.select(F.lit(-1).alias("file_id"), "line_no", "value").unionByName(lines.select(F.col("file_id").cast("int").alias("file_id"), "line_no", "value"))


def folder_files(spark: SparkSession, folder: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """All files below a folder, in full order of their paths, without those named in ``skip``: file, line_no, value."""
    x = numbered_lines(spark, folder, recursive=True)
    return x.where(~F.element_at(F.split("file", "/"), -1).isin(*skip)) if skip else x


def with_session_starts(lines: DataFrame) -> DataFrame:
    """Every file is a session: session_start on its first line."""
    return lines.withColumn("session_start", F.col("line_no") == 1)


def class_of_path(path: Column) -> Column:
    """The class cNNN that a path has as a folder; null for none."""
    c = F.regexp_extract(path, r"(?:^|/)(c[0-9]{3})/", 1)
    return F.when(c != "", c)


def with_classes(lines: DataFrame) -> DataFrame:
    """Lines of files below class folders: class_label, sample_no (files of a class in order of their numbers)."""
    files = lines.select("file").distinct().withColumn("class_label", class_of_path(F.col("file"))).where("class_label IS NOT NULL")
    number = F.substring(F.element_at(F.split("file", "/"), -1), -7, 3)
    files = files.withColumn("sample_no", F.row_number().over(Window.partitionBy("class_label").orderBy(number, "file")))
    return lines.join(files, "file")


def template_library(spark: SparkSession, path: str) -> DataFrame:
    """A template library from CSV, all text as written: eventidold, eventid, eventtemplate."""
    schema = "EventIdOld string, EventId string, EventTemplate string"
    x = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="\0")
    return x.toDF("eventidold", "eventid", "eventtemplate")


def structured_log(spark: SparkSession, path: str) -> DataFrame:
    """A structured log from CSV or parquet."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, nullValue="\0")
    return spark.read.parquet(path)


def knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """Rules without parameters from YAML (id: severity, contxt, descpt): eventid, severity, contxt, descpt."""
    import yaml

    d = yaml.safe_load(Path(path).read_text()) or {}
    return spark.createDataFrame([(k, v.get("severity"), v.get("contxt"), v.get("descpt")) for k, v in d.items()], "eventid string, severity string, contxt boolean, descpt string")


def class_table(spark: SparkSession, path: str) -> DataFrame:
    """Classes from YAML (cNNN: desc, refs): class_label, class_desc, refs."""
    import yaml

    d = yaml.safe_load(Path(path).read_text()) or {}
    return spark.createDataFrame([(k, v.get("desc"), v.get("refs")) for k, v in d.items()], "class_label string, class_desc string, refs string")


def file_list(path: str) -> list[str]:
    """Names of a list file, in its order."""
    return [x.strip() for x in Path(path).read_text().splitlines() if x.strip()]
