"""Queries of sources, sinks and saved models: test tables written in some form and read again, and SQL for what they hold."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.config import for_log_type
from timberline.models import detectors
from timberline.operators import matrix, normalise, rules, vocabulary
from timberline.plans.shared import shared_dir
from timberline.plans.tables import table
from timberline.queries import _JUDGED, _REC, _STATIC, _VOCAB, SIZE, _session_cells, judged, query, records
from timberline.sources import readers, writers


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share, beside the written tables."""
    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"


def _driver_file(name: str) -> str:
    """A file of the driver alone, for settings it writes and reads itself."""
    import tempfile

    return f"{tempfile.mkdtemp(prefix='timberline-')}/{name}"


_ONE = "translate(coalesce(content, ''), chr(13) || chr(10), '  ')"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).select("file_id", F.col("lineid").alias("line_no"), F.translate(F.coalesce("content", F.lit("")), "\r\n", "  ").alias("value"))


def _file_id() -> Column:
    """The file number in a path; made when called, as columns need a session and modules are imported without one."""
    return F.regexp_extract("file", r"/file_id=(\d+)/", 1).cast("int")


_IN_FILES = f"""{_REC}, files AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY lineid) AS line_no, {_ONE} AS "value" FROM rec)"""


@query(f"""WITH {_IN_FILES} SELECT file_id, line_no, "value", line_no = 1 AS session_start FROM files""")
def q_folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """The log written as a text file per log file, and all files below the folder read again, each a session."""
    out = _folder(spark)
    writers.write_files(_lines(spark, folder), out)
    x = readers.with_session_starts(readers.folder_files(spark, out, skip=("_SUCCESS",)))
    return x.select(_file_id().alias("file_id"), "line_no", "value", "session_start")


@query(f"""WITH {_IN_FILES} SELECT (dense_rank() OVER (ORDER BY file_id DESC) - 1)::INT AS ordinal, line_no, "value" FROM files""")
def q_listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files in the order of a list: that of descending file numbers."""
    import re

    out, listed = _folder(spark), _driver_file("train.lst")
    writers.write_files(_lines(spark, folder), out)
    files = spark.read.option("recursiveFileLookup", "true").text(out).inputFiles()
    files.sort(key=lambda f: -int(re.search(r"/file_id=(\d+)/", f).group(1)))
    with open(listed, "w") as f:
        f.write("\n".join(files) + "\n\n")
    return readers.concatenated_files(spark, readers.file_list(listed)).select("ordinal", "line_no", "value")


@query(f"""WITH {_IN_FILES}, c AS (SELECT file_id, class_label, row_number() OVER (PARTITION BY class_label ORDER BY file_id::VARCHAR) AS sample_no FROM log_files WHERE class_label <> '' AND file_id IN (SELECT file_id FROM rec))
SELECT class_label, sample_no::INT AS sample_no, file_id, line_no, "value" FROM files JOIN c USING (file_id)""")
def q_class_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Files below folders of their classes."""
    out = _folder(spark)
    x = _lines(spark, folder).join(table(spark, folder, "log_files").where("class_label <> ''").select("file_id", "class_label"), "file_id")
    for c in [r[0] for r in table(spark, folder, "classes_loglab").select("class_label").distinct().orderBy("class_label").collect()]:
        writers.write_files(x.where(F.col("class_label") == c), f"{out}/{c}")
    x = readers.with_classes(readers.folder_files(spark, out))
    return x.select("class_label", "sample_no", _file_id().alias("file_id"), "line_no", "value")


@query(f"""WITH {_REC} SELECT (CASE WHEN k = 0 THEN -1 ELSE file_id END)::INT AS file_id, line_no, "value" FROM (
  SELECT 0 AS k, NULL AS file_id, row_number() OVER (ORDER BY eventid) AS line_no, eventtemplate AS "value" FROM template_lib UNION ALL SELECT 1, file_id, lineid, {_ONE} FROM rec)""")
def q_sample_first(spark: SparkSession, folder: str) -> DataFrame:
    """A curated sample, here the texts of the library, before the log."""
    sample = table(spark, folder, "template_lib").select(F.lit(0).alias("all"), "eventid", F.col("eventtemplate").alias("value"))
    sample = sample.withColumn("line_no", F.row_number().over(Window.orderBy("eventid")).cast("long"))
    return readers.with_sample_first(_lines(spark, folder), sample)


@query(f"""WITH {_REC} SELECT row_number() OVER (ORDER BY lineid) AS k, {_ONE} AS "value" FROM rec""")
def q_text_dump(spark: SparkSession, folder: str) -> DataFrame:
    """The log dumped as text in line order over all files, and read again: parts in order, lines in order."""
    out = _folder(spark)
    writers.write_lines(_lines(spark, folder), out, ["line_no"])
    x = readers.numbered_lines(spark, out)
    parts = spark.createDataFrame([(i, f) for i, f in enumerate(sorted(x.inputFiles()))], "source int, file string")
    x = x.withColumn("file", F.regexp_replace("file", "^file:/+", "/")).join(parts.withColumn("file", F.regexp_replace("file", "^file:/+", "/")), "file")
    return readers.concatenated([x.select("source", "line_no", "value")], ["source", "line_no"]).select(F.col("line_id").alias("k"), "value")


@query("SELECT eventidold, eventid, eventtemplate FROM template_lib")
def q_library_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The template library as CSV and back: texts stay as they are, blanks at their ends too."""
    out = _folder(spark)
    x = table(spark, folder, "template_lib").select(F.col("eventidold").alias("EventIdOld"), F.col("eventid").alias("EventId"), F.col("eventtemplate").alias("EventTemplate"))
    x.write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("nullValue", "\0").csv(out)
    return readers.template_library(spark, out)


@query("SELECT eventidold, eventid, eventtemplate FROM template_lib")
def q_library_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Of several versions of a library the newest; older ones stay."""
    out, x = _folder(spark), table(spark, folder, "template_lib").select("eventidold", "eventid", "eventtemplate")
    writers.write_library(x.where("eventidold IS NOT NULL"), out, "20230101T000000000000")
    writers.write_library(x, out, "20230102T000000000000")
    return writers.latest_library(spark, out)


@query(f"WITH {_REC} SELECT file_id, lineid, time, {_ONE} AS content, eventid, eventtemplate FROM rec")
def q_structured_reload(spark: SparkSession, folder: str) -> DataFrame:
    out = _folder(spark)
    x = records(spark, folder).select("file_id", "lineid", "time", F.translate(F.coalesce("content", F.lit("")), "\r\n", "  ").alias("content"), "eventid", "eventtemplate")
    writers.write_structured(x, out)
    return readers.structured_log(spark, out)


@query("SELECT eventid, max(severity) AS severity, bool_or(contxt) AS contxt, max(descpt) AS descpt FROM kb_no_para WHERE eventid IS NOT NULL GROUP BY eventid")
def q_yaml_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules without parameters as YAML and back."""
    import yaml

    path = _driver_file("kb.yaml")
    rows = table(spark, folder, "kb_no_para").where("eventid IS NOT NULL").groupBy("eventid").agg(F.max("severity").alias("severity"), F.max("contxt").alias("contxt"), F.max("descpt").alias("descpt")).collect()
    with open(path, "w") as f:
        yaml.safe_dump({r["eventid"]: {"severity": r["severity"], "contxt": r["contxt"], "descpt": r["descpt"]} for r in rows}, f)
    return readers.knowledge_base(spark, path)


@query("SELECT class_label, class_desc, refs FROM classes_loglab")
def q_yaml_classes(spark: SparkSession, folder: str) -> DataFrame:
    import yaml

    path = _driver_file("classes.yaml")
    rows = table(spark, folder, "classes_loglab").collect()
    with open(path, "w") as f:
        yaml.safe_dump({r["class_label"]: {"desc": r["class_desc"], "refs": r["refs"]} for r in rows}, f)
    return readers.class_table(spark, path)


_OWN_CONFIG = {"template": {"library_size": SIZE}, "windows": {"size_ms": 5_000, "step_ms": 1_000}}


@query(f"WITH {_VOCAB} SELECT eventid, idx FROM vocab")
def q_saved_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """A detector's vocabulary, saved and loaded with the detector."""
    out = _folder(spark)
    d = detectors.SequenceDetector(for_log_type("ftp").override(_OWN_CONFIG)).fit(records(spark, folder).where("eventid IS NOT NULL"), table(spark, folder, "template_lib"), "session_id")
    detectors.save(d, out)
    return detectors.load(detectors.SequenceDetector(d.config), spark, out).vocabulary


@query(f"WITH {_JUDGED} SELECT lineid, coalesce(time, lineid::VARCHAR) AS place, severity, advice FROM judged WHERE severity <> 'info'")
def q_report_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The expert report as CSV and back."""
    out = _folder(spark)
    writers.write_report(rules.expert_report(judged(spark, folder)).select("lineid", "place", "severity", "advice"), out)
    return spark.read.csv(out, header=True, quote='"', escape='"', schema="lineid long, place string, severity string, advice string")


@query(f"""WITH {_REC}, {_STATIC}, cells AS (SELECT session_id, eventid, count(*) AS n FROM rec WHERE eventid IS NOT NULL AND session_id IS NOT NULL GROUP BY ALL)
SELECT voc.eventid, count(n) AS sessions, coalesce(sum(n), 0)::DOUBLE AS total FROM voc LEFT JOIN cells USING (eventid) GROUP BY voc.eventid""")
def q_matrix_dump(spark: SparkSession, folder: str) -> DataFrame:
    """A count matrix dumped with a column per event; of each column the sessions that have it and its sum."""
    out, v = _folder(spark), vocabulary.static(table(spark, folder, "template_lib"))
    cells, instances = _session_cells(spark, folder)
    writers.write_matrix(matrix.vectors(vocabulary.indexed(cells, v), instances, ["session_id"], v.count(), value="value"), v, out)
    x = spark.read.csv(out, header=True)
    names = [c for c in x.columns if c != "label"]
    sums = x.agg(*[F.struct(F.count_if(F.col(f"`{c}`").cast("double") > 0).alias("sessions"), F.sum(F.col(f"`{c}`").cast("double")).alias("total")).alias(c) for c in names])
    each = F.array(*[F.struct(F.lit(c).alias("eventid"), F.col(f"`{c}`.sessions"), F.col(f"`{c}`.total")) for c in names])
    return sums.select(F.explode(each).alias("e")).select("e.eventid", "e.sessions", F.coalesce("e.total", F.lit(0.0)).alias("total"))


@query(f"WITH {_REC} SELECT lineid, content[1:5] = 'INFO ' AS info, md5(content) AS content_md5 FROM rec WHERE content LIKE '% - %' AND time IS NOT NULL")
def q_format_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Records by a format of two fields, time and content, told from the format's pattern."""
    x = records(spark, folder).where("content LIKE '% - %' AND time IS NOT NULL").select("lineid", F.concat(F.translate("time", " ", "_"), F.lit(" "), F.translate("content", "\r\n", "\x01\x02")).alias("line"))
    x = normalise.split_format(x, ("Time", "Content"), "line")
    content = F.translate("content_part", "\x01\x02", "\r\n")
    return x.select("lineid", content.startswith("INFO ").alias("info"), F.md5(content).alias("content_md5"))

