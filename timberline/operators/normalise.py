"""One record per entry: nested lines joined to their primary line, labels and sessions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.islands import along, carried, running_count
from timberline.operators.wash import is_nested
from timberline.plans.shared import materialise


def join_nested(lines: DataFrame, group: str = "file_id", order: str = "line_no", text: str = "body", nested: Column | None = None) -> DataFrame:
    """Records: group, order (of the primary line), lines, and the text of all lines joined by a comma and a blank.

    A record is one string, so its lines meet in one row; records themselves are spread.
    """
    nested = is_nested(F.col(text)) if nested is None else nested
    x = carried(lines.withColumn("_nested", nested), group, order, F.when(~F.col("_nested"), F.col(order)), "_primary").where("_primary IS NOT NULL")
    parts = _in_order(order, text)
    x = x.groupBy(group, F.col("_primary").alias(order)).agg(parts.alias("_parts"))
    return x.select(group, order, F.size("_parts").alias("lines"), _put_together("_parts").alias(text))


def _in_order(order: str, text: str) -> Column:
    """Aggregate: texts in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda p: p["t"])


def _put_together(parts: str) -> Column:
    """The lines of a record as one text."""
    blanks = F.lit(" \t\r\n")
    # blanks go where lines meet: behind all lines but the last, before all but the first
    n = F.size(parts)
    joined = F.array_join(F.transform(parts, lambda t, i: F.when(i == 0, F.rtrim(t, blanks)).when(i == n - 1, F.ltrim(t, blanks)).otherwise(F.trim(t, blanks))), ", ")
    return F.when(n > 1, joined).otherwise(F.element_at(parts, 1))


def normalise(washed: DataFrame) -> DataFrame:
    """Records of washed lines with their primary line's columns: content, label, session_no, class_label.

    Lines that were washed without their text give records without content.
    """
    text = "body" in washed.columns
    x = materialise(washed.withColumn("nested", is_nested(F.col("body"))) if text else washed)
    n = F.col("line_no")
    # a record's further lines are few: they go to its primary line
    more = along(x.select("file_id", "line_no", "nested", *["body"] * text), "file_id", "line_no", {"primary": F.when(~F.col("nested"), n)}).where("nested AND primary IS NOT NULL")
    more = more.groupBy("file_id", F.col("primary").alias("line_no")).agg(F.count(F.lit(1)).alias("more"), *[_in_order("line_no", "body").alias("texts")] * text)
    heads = along(x.where("NOT nested"), "file_id", "line_no", {}, {"session_no": F.col("marked")})
    x = heads.join(more, ["file_id", "line_no"], "left")
    if text:
        x = x.withColumn("parts", F.concat(F.array("body"), F.coalesce("texts", F.array().cast("array<string>"))))
    lines = (1 + F.coalesce("more", F.lit(0))).cast("int").alias("lines")
    return x.select("file_id", "line_no", "ts_text", *[_put_together("parts").alias("content")] * text, F.col("abnormal").cast("int").alias("label"), "marked", "session_no", "class_label", lines)


def label_of(content: Column) -> tuple[Column, Column]:
    """The abnormal label (0 or 1) in the first five characters of a content, and the content without it."""
    has = F.substring(content, 1, 5).startswith("abn: ")
    return has.cast("int"), F.when(has, F.substr(content, F.lit(6))).otherwise(content)


def session_sizes(records: DataFrame, group: str, order: str, starts: Column) -> DataFrame:
    """Sessions by their markers: group, session_no (0 before the first marker), first, n."""
    x = running_count(records, group, order, starts, "session_no")
    return x.groupBy(group, "session_no").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))


def format_pattern(fields: tuple[str, ...]) -> str:
    """The pattern of a record from its fields: words, then the rest; one group per field."""
    return "^" + r"\s+".join("(.*?)" for _ in fields) + "$"


def split_format(records: DataFrame, fields: tuple[str, ...], text: str) -> DataFrame:
    """Adds one column per field of the format; records that don't fit go, line numbers stay as they were."""
    p = format_pattern(fields)
    x = records.where(F.col(text).rlike(p))
    return x.withColumns({f.lower() + "_part": F.regexp_extract(text, p, i + 1) for i, f in enumerate(fields)})
