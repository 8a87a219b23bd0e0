"""Washing raw lines: timestamp and labels off, noise out, words split, sessions marked.

Lines are (file_id, line_no, value). The result keeps file_id and line_no, so there are no line maps: every later
table still knows the raw line it came from. Labels of lines that go are handed to the next line that stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import split_apart
from timberline.logtypes import LogType
from timberline.logtypes.base import EMPTY, FUZZY_TIME, NESTED
from timberline.operators.islands import along, running_count
from timberline.plans.shared import join_counted, materialise


def take_head(lines: DataFrame, log: LogType, width: int | None = None, column: str = "value") -> DataFrame:
    """Splits lines into ts_text, labels (abnormal, marked, class_label) and body.

    With ``width`` (a learnt one) the head is that many characters; lines whose head holds no time of any form are
    dropped, and there are no labels; width 0 means there is no timestamp. Without it the log type's pattern must match.
    """
    v = F.col(column)
    none = F.lit(None).cast("string")
    if width == 0:
        return lines.select("file_id", "line_no", F.lit("").alias("ts_text"), F.lit(False).alias("abnormal"), F.lit(False).alias("marked"), none.alias("class_label"), v.alias("body"))
    if width is not None:
        head = F.substring(v, 1, width)
        x = lines.where((F.length(v) >= width) & head.rlike(FUZZY_TIME))
        return x.select("file_id", "line_no", F.trim(head).alias("ts_text"), F.lit(False).alias("abnormal"), F.lit(False).alias("marked"), none.alias("class_label"), F.substr(v, F.lit(width + 1)).alias("body"))
    head = F.regexp_extract(v, log.timestamp, 0)
    label = F.regexp_extract(head, r"(c[0-9]{3}) $", 1)
    x = lines.withColumn("head", head).where("head <> ''")
    stamp = F.regexp_replace("head", r"(abn: )?(segsign: )?(c[0-9]{3} )?$", "")
    return x.select(
        "file_id", "line_no", F.trim(stamp).alias("ts_text"), F.contains("head", F.lit("abn: ")).alias("abnormal"), F.contains("head", F.lit("segsign: ")).alias("marked"),
        F.when(label != "", label).alias("class_label"), F.substr(v, F.length("head") + 1).alias("body"),
    )


def is_nested(line: Column) -> Column:
    return line.rlike(NESTED)


def is_empty(line: Column) -> Column:
    return line.rlike(EMPTY)


def clean_head(lines: DataFrame) -> DataFrame:
    """Drops the nested and empty lines that precede the first primary one of each file."""
    primary = ~(is_nested(F.col("body")) | (F.col("body") == ""))
    first = lines.where(primary).groupBy("file_id").agg(F.min("line_no").alias("first_primary"))
    return lines.join(first, "file_id").where("line_no >= first_primary").drop("first_primary")


def without_empty(lines: DataFrame) -> DataFrame:
    """Drops empty lines; empty_before tells how many stood directly before a line that stays."""
    x = running_count(lines, "file_id", "line_no", ~is_empty(F.col("body")), "kept")
    gaps = x.where(is_empty(F.col("body"))).groupBy("file_id", (F.col("kept") + 1).alias("kept")).agg(F.count(F.lit(1)).alias("empty_before"))
    return x.where(~is_empty(F.col("body"))).join(gaps, ["file_id", "kept"], "left").withColumn("empty_before", F.coalesce("empty_before", F.lit(0))).drop("kept")


def hand_over_labels(lines: DataFrame) -> DataFrame:
    """Lines that stay (column kept), with session marks and class labels of the lines before them that go; of several classes the latest."""
    n, goes = F.col("line_no"), ~F.col("kept")
    lasts = {"at": F.when(F.col("kept"), n), "mark": F.when(goes & F.col("marked"), n), "label": F.when(goes & F.col("class_label").isNotNull(), F.struct(n.alias("n"), F.col("class_label").alias("c")))}
    x = along(lines.where("kept OR marked OR class_label IS NOT NULL"), "file_id", "line_no", lasts, before=True).where("kept")
    # only what stands behind the last line that stayed
    marked, label = F.col("mark") > F.coalesce("at", F.col("mark") - 1), F.when(F.col("label.n") > F.coalesce("at", F.col("label.n") - 1), F.col("label.c"))
    return x.withColumns({"marked": F.col("marked") | F.coalesce(marked, F.lit(False)), "class_label": F.coalesce("class_label", label)}).drop("at", "mark", "label")


def cleaned(body: Column, log: LogType) -> Column:
    """A line's body without noise; of records glued together the last one; responses in their common words."""
    if log.glued:
        # a record glued behind another: the last inner timestamp begins what is kept
        last = F.regexp_extract(body, rf"^(?s).{{2}}.*({log.glued}.*)$", 1)
        body = F.when(~is_nested(body) & ~body.rlike(r"^ *----") & (last != ""), last).otherwise(body)
    body = F.regexp_replace(body, log.clean, "")
    return log.normalise(body) if log.normalise else body


def wash(lines: DataFrame, log: LogType, width: int | None = None, lite: bool = False, max_line: int | None = None, text: bool = True) -> DataFrame:
    """Washed lines: file_id, line_no, ts_text, abnormal, marked, class_label, body; without ``text`` column nested instead of body.

    ``lite`` is the short form for learning the timestamp's width: first ``max_line`` lines, no head, fewer splits.
    """
    if lite:
        x = lines if max_line is None else lines.where(F.col("line_no") <= max_line)
        body = F.regexp_replace("value", log.clean, "")
        x = x.select("file_id", "line_no", body.alias("body")).where(~is_empty(F.col("body")))
        return x.withColumn("body", split_apart(F.col("body"), log.lite_left, log.lite_right))
    names = ["file_id", "line_no", "ts_text", "abnormal", "marked", "class_label"]
    body = F.col("body")

    def told(x: DataFrame) -> DataFrame:
        """Patterns are looked for once, before anything is filtered or sorted: whether a line is empty, nested, a session's beginning."""
        x = x.withColumn("empty", is_empty(body)).withColumn("body", split_apart(body, log.split_left, log.split_right))
        x = x.withColumns({"session": body.rlike(log.session), "nested": is_nested(body)})
        return x if text else x.drop("body")

    x = take_head(lines, log, width).withColumn("primary", ~(is_nested(body) | (body == ""))).withColumn("body", cleaned(body, log))
    headed = materialise(x if log.scan else told(x))
    first = headed.where("primary").groupBy("file_id").agg(F.min("line_no").alias("first_primary"))
    x = join_counted(headed, materialise(first), ["file_id"]).withColumn("kept", F.col("line_no") >= F.col("first_primary")).drop("first_primary", "primary")
    if log.scan:
        stay = materialise(told(log.scan(x.where("kept"))).where("NOT empty"))
        go = x.where("marked OR class_label IS NOT NULL").join(stay.select("file_id", "line_no"), ["file_id", "line_no"], "left_anti").select(*names, F.lit(False).alias("kept"))
        x = stay.unionByName(go, True)
    else:
        x = x.withColumn("kept", F.col("kept") & ~F.col("empty"))
    x = hand_over_labels(x) if width is None else x.where("kept")
    return x.withColumn("marked", F.col("marked") | F.col("session")).select(*names, "body" if text else "nested")
