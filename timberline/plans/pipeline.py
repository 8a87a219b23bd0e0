"""Whole runs: raw lines to a structured log, an expert report, and the inputs of the detectors.

Modes are arguments, not global state: ``width`` None means the log type's own timestamp with labels (training and
validation), a number means a learnt width (prediction), 0 no timestamp.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.config import Config
from timberline.functions.text import mask, parameters
from timberline.logtypes import LOG_TYPES, LogType
from timberline.operators import heads, mining, normalise, rules, wash
from timberline.plans.shared import join_counted, materialise

FOREIGN = -1


@dataclass
class Structured:
    """records: file_id, lineid (raw line), time, content, label, session_no, eventid, eventtemplate, params."""

    records: DataFrame
    templates: DataFrame
    width: int | None


def learn_timestamp(lines: DataFrame, log: LogType, library: DataFrame, max_line: int) -> int:
    """The width of an unknown timestamp, learnt from the first lines; FOREIGN if the log is of another kind."""
    x = wash.wash(lines, log, lite=True, max_line=max_line)
    x = x.select(F.col("line_no"), F.col("body").alias("content"))
    assigned, _ = mining.mine(x, log, library, "line_no", "content")
    x = x.withColumn("masked", mask(F.col("content"), log.masks)).join(assigned, "masked")
    row = heads.learn_width(x, library, "line_no").first()
    return int(row["width"])


def structure(lines: DataFrame, config: Config, library: DataFrame | None = None, width: int | None = None, learn: bool = False, repair: bool = False) -> Structured:
    """Washes, joins and mines lines (file_id, line_no, value).

    ``learn`` learns the timestamp's width first; a log of another kind then gives no records. ``repair`` puts torn
    records together again and mines a second time, without masks.
    """
    log = LOG_TYPES[config.general.log_type]
    if learn:
        if library is None:
            raise ValueError("a library is needed to learn from")
        width = learn_timestamp(lines, log, library, config.general.max_line)
    if width == FOREIGN:
        lines, width = lines.limit(0), 0
    records = normalise.normalise(wash.wash(lines, log, width)).withColumnRenamed("line_no", "lineid").withColumnRenamed("ts_text", "time")
    # ids are unique in files only: a global order for mining
    records = materialise(records.withColumn("seen", F.col("file_id").cast("long") * F.lit(1 << 40) + F.col("lineid")))
    assigned, templates = mining.mine(records, log, library, "seen")
    # a curated sample is there to be mined first, not to be judged
    records = records.where("file_id >= 0")
    out = records.withColumn("masked", mask(F.col("content"), log.masks)).join(assigned, "masked", "left")
    if repair and library is not None:
        known = templates.select("eventid", "eventidold")
        torn = join_counted(out.where("eventid IS NOT NULL"), known, ["eventid"])
        fixed = materialise(heads.repair_torn(torn, library, log, "lineid").drop("eventid", "eventidold", "masked"))
        assigned, templates = mining.mine(fixed, log, library, "seen", "eventtemplate", masked=True)
        out = fixed.withColumn("masked", F.col("eventtemplate")).drop("eventtemplate").join(assigned, "masked", "left")
    out = out.withColumn("params", parameters(F.col("content"), F.col("eventtemplate")))
    return Structured(out.drop("masked", "seen"), templates, width)


def expert_report(lines: DataFrame, config: Config, library: DataFrame, knowledge: DataFrame, learn: bool = True) -> tuple[DataFrame, DataFrame]:
    """The report of records that matter, and the distinct advice in order."""
    s = structure(lines, config, library, learn=learn)
    book = rules.CM_RULES if config.general.log_type == "cm" else rules.FTP_RULES
    judged = rules.judged(s.records, knowledge, book)
    return rules.expert_report(judged, "time" if s.width else "lineid"), rules.top_advice(judged)
