"""Commands over files: python -m timberline COMMAND ...

config (show, default, set), info; wash, normalise, templates (learn from logs), library (sort, delete), report (rules),
diagnose, windows and sequences with train, validate and predict; duplicates, times and find on logs. Inputs are text
files, folders, or lists of files; results are written as parquet or CSV folders.
"""

from __future__ import annotations

import argparse
import platform

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.config import Config, Paths, for_log_type
from timberline.functions.times import time_millis
from timberline.logtypes import LOG_TYPES
from timberline.models import detectors, incremental
from timberline.operators import normalise, rules, tools, wash, windows
from timberline.plans import pipeline
from timberline.plans.shared import join_counted
from timberline.sources import readers, writers

#: What ``--model ALL`` runs.
ALL = {"diagnose": ["forest_multi", "logistic_multi", "vectors_multi"], "windows": ["tree", "forest", "logistic", "vectors", *incremental.NAMES], "sequences": ["counts", "network"]}


def lines_of(spark: SparkSession, paths: list[str], listed: bool = False) -> DataFrame:
    """Lines of files or folders with file numbers in order of their paths, or of lists: file_id, file, line_no, value."""
    if listed:
        x = readers.concatenated_files(spark, [f for p in paths for f in readers.file_list(p)])
        return x.select(F.col("ordinal").alias("file_id"), "file", "line_no", "value")
    x = readers.numbered_lines(spark, paths, recursive=True)
    files = x.select("file").distinct().withColumn("file_id", (F.row_number().over(Window.orderBy("file")) - 1).cast("int"))
    return join_counted(x, files, ["file"]).select("file_id", "file", "line_no", "value")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="timberline", description=__doc__)
    p.add_argument("--type", choices=sorted(LOG_TYPES), default="ftp", help="kind of log")
    p.add_argument("--config", action="append", default=[], help="YAML that changes settings")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("config")
    c.add_argument("action", nargs="?", choices=["show", "default", "set"], default="show")
    c.add_argument("settings", nargs="*", help="section.key=value, for set")
    c.add_argument("--out", help="YAML file for the result")
    sub.add_parser("info")
    c = sub.add_parser("library")
    c.add_argument("action", choices=["sort", "delete"])
    c.add_argument("--library", required=True, help="folder of template library versions")
    for name in ("wash", "normalise", "templates", "report", "diagnose", "windows", "sequences", "duplicates", "times", "find"):
        c = sub.add_parser(name)
        c.add_argument("paths", nargs="+", help="text files or folders")
        c.add_argument("--list", action="store_true", help="the paths are lists of files, in order")
        c.add_argument("--out", required=True, help="folder for the result")
        c.add_argument("--library", help="folder of template library versions")
        if name in ("report", "diagnose", "sequences"):
            c.add_argument("--rules", required=name != "sequences", help="YAML of rules without parameters")
        if name == "templates":
            c.add_argument("--sample", help="text file that is mined before the log")
            c.add_argument("--debug", action="store_true", help="also write how templates were found")
        if name == "find":
            c.add_argument("--event", required=True, help="id of the records to find")
        if name == "times":
            c.add_argument("--start", type=int, default=1_640_995_200_000_000, help="first time, microseconds since 1970")
        if name == "diagnose":
            c.add_argument("--classes", help="YAML of classes, for predict")
            c.add_argument("--feat", action="store_true", help="only write the features of the samples")
            c.add_argument("--leave-one-out", action="store_true", help="each sample by a model of all others")
        if name in ("diagnose", "windows", "sequences"):
            c.add_argument("--phase", choices=["train", "validate", "predict"], default="predict")
            c.add_argument("--model-dir", required=True)
            c.add_argument("--model", default=None, help="name of the classifier, or ALL")
            c.add_argument("--debug", action="store_true", help="also write the matrix")
        if name == "windows":
            c.add_argument("--inc", action="store_true", help="learn on from what the model has learnt")
        if name == "sequences":
            c.add_argument("--repair", action="store_true", help="put torn records together again")
        c.add_argument("--learn-width", action="store_true", help="learn the timestamp's width from the library")
        c.add_argument("--host", action="store_true", help="lines have no timestamp")
    return p


def _set(config: Config, settings: list[str]) -> Config:
    import yaml

    for s in settings:
        name, _, value = s.partition("=")
        section, _, key = name.partition(".")
        config = config.override({section: {key: yaml.safe_load(value)}})
    return config


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    config = for_log_type(a.type)
    for path in a.config:
        import yaml

        with open(path) as f:
            config = config.override(yaml.safe_load(f) or {})
    if a.command == "config":
        shown = (Config() if a.action == "default" else _set(config, a.settings)).show()
        if a.out:
            with open(a.out, "w") as f:
                f.write(shown)
        print(shown)
        return 0
    if a.command == "info":
        import pyspark

        print(f"kind of log: {a.type}\nPython {platform.python_version()}, PySpark {pyspark.__version__}\n{Paths().show()}")
        return 0
    spark = spark or SparkSession.builder.appName("timberline").getOrCreate()
    if a.command == "library":
        library = writers.latest_library(spark, a.library)
        writers.write_library(tools.sorted_library(library) if a.action == "sort" else library.limit(0), a.library)
        return 0
    log, lines = LOG_TYPES[a.type], lines_of(spark, a.paths, a.list)
    if a.command in ("wash", "normalise"):
        x = wash.wash(lines, log)
        (normalise.normalise(x) if a.command == "normalise" else x).write.mode("overwrite").parquet(a.out)
        return 0
    if a.command == "duplicates":
        x = lines.withColumn("place", F.struct("file_id", "line_no"))
        writers.write_report(tools.duplicate_members(x, ["value"], "place").select("value", "copies", "place.file_id", "place.line_no"), a.out)
        return 0
    library = _library(spark, a.library)
    if a.command == "times":
        # heads of the log's own or a learnt width give way to invented times
        width = pipeline.learn_timestamp(lines, log, library, config.general.max_line) if a.learn_width else log.width
        x = windows.synthetic_times(lines.withColumn("seen", F.col("file_id").cast("long") * F.lit(1 << 40) + F.col("line_no")), "seen", a.start)
        stamp = F.timestamp_add("MICROSECOND", F.col("micros"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("string")
        x = x.withColumn("value", F.concat(stamp, F.lit(" "), F.substr("value", F.lit(max(width, 0) + 1))))
        writers.write_lines(x, a.out, ["seen"])
        return 0
    if a.command == "templates":
        if a.sample:
            lines = readers.with_sample_first(lines, readers.numbered_lines(spark, a.sample))
        s = pipeline.structure(lines, config, library)
        s.records.write.mode("overwrite").parquet(a.out)
        if a.debug:
            writers.write_report(s.records.groupBy("eventid", "eventtemplate").agg(F.count(F.lit(1)).alias("records"), F.min("lineid").alias("first_line")), f"{a.out}-debug")
        writers.write_library(s.templates, a.library or f"{a.out}-library")
        return 0
    if a.command == "find":
        s = pipeline.structure(lines, config, library, learn=a.learn_width, width=0 if a.host else None)
        writers.write_report(tools.records_of(s.records, a.event), a.out)
        return 0
    if a.command == "report":
        report, advice = pipeline.expert_report(lines, config, library, readers.knowledge_base(spark, a.rules), a.learn_width)
        writers.write_report(report, f"{a.out}/report")
        writers.write_report(advice, f"{a.out}/advice")
        return 0
    names = ALL[a.command] if a.model == "ALL" else [a.model]
    for name in names:
        place = f"/{name}" if a.model == "ALL" else ""
        _detect(a, spark, config, lines, library, name, place)
    return 0


def _library(spark: SparkSession, folder: str | None) -> DataFrame | None:
    """The newest version of a library; none where there is no version yet."""
    from pyspark.errors import AnalysisException

    try:
        return writers.latest_library(spark, folder) if folder else None
    except AnalysisException:
        return None


def _detect(a: argparse.Namespace, spark: SparkSession, config: Config, lines: DataFrame, library: DataFrame | None, name: str | None, place: str) -> None:
    s = pipeline.structure(lines, config, library, learn=a.learn_width, width=0 if a.host else None, repair=getattr(a, "repair", False))
    library = s.templates if library is None else library
    records, train, out, models = s.records.withColumn("t", time_millis(F.col("time"))), a.phase == "train", a.out + place, a.model_dir + place
    book = rules.CM_RULES if config.general.log_type == "cm" else rules.FTP_RULES
    if a.command == "windows":
        d = detectors.WindowDetector(config, name or ("bayes" if a.inc else "logistic"))
        if train and a.inc:
            try:
                d = detectors.load(d, spark, models)
            except Exception:  # noqa: BLE001 - nothing learnt yet
                pass
            d = d.partial_fit(records, library, "file_id", "t")
        else:
            d = d.fit(records, library, "file_id", "t") if train else detectors.load(d, spark, models)
        result = d.evaluate(records, "file_id", "t") if a.phase == "validate" else d.transform(records, "file_id", "t")
        if a.debug:
            writers.write_matrix(d.data(records, "file_id", "t", False)[1], d.vocabulary, f"{out}-matrix")
    elif a.command == "sequences":
        d = detectors.SequenceDetector(config, name or "counts")
        session = records.withColumn("session", F.col("file_id").cast("long") * F.lit(1 << 40) + F.col("session_no"))
        d = d.fit(session, library, "session") if train else detectors.load(d, spark, models)
        known = readers.knowledge_base(spark, a.rules) if a.rules else None
        if a.phase == "validate":
            result = d.evaluate(session, "session", knowledge=known, book=book)
        else:
            result = d.transform(session, "session", knowledge=known, book=book).where("anomalous = 1").drop("event_seq")
    else:
        d = detectors.ContextClassifier(config, readers.knowledge_base(spark, a.rules), book, name or "forest_multi")
        samples = records.withColumn("sample_id", F.col("file_id"))
        if a.feat:
            writers.write_report(d.features(samples, "sample_id"), out)
            return
        labels = lines.groupBy(F.col("file_id").alias("sample_id")).agg(readers.class_of_path(F.min("file")).alias("class_label")).where("class_label IS NOT NULL")
        if a.leave_one_out:
            writers.write_report(d.leave_one_out(samples, labels, library), out)
            return
        d = d.fit(samples, labels, library) if train else detectors.load(d, spark, models)
        result = d.transform(samples, readers.class_table(spark, a.classes)) if a.classes else None
    if train:
        detectors.save(d, models)
    if result is not None:
        writers.write_report(result, out)
