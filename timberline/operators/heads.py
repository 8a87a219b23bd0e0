"""Learning the width of an unknown timestamp, and repairing records torn by concurrent writers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import template_id
from timberline.logtypes import LogType
from timberline.operators.folds import folded
from timberline.plans.shared import join_counted, materialise

#: Fixed value: longest timestamp that is tried.
MAX_WIDTH = 50


def smallest_cuts(keyed: DataFrame, library: DataFrame, text: Column, most: int | None, least: int = 0) -> DataFrame:
    """_key and cut: the smallest number of characters whose removal leaves a template of the library, where there is one."""
    at = F.sequence(F.lit(least), F.least(F.length(text) - 1, F.lit(most)) if most is not None else F.length(text) - 1)
    ids = library.select(F.col("eventid").alias("_id")).distinct()
    tails = keyed.where(F.length(text) > least).select("_key", F.explode(at).alias("cut"), text.alias("_t"))
    tails = tails.select("_key", "cut", template_id(F.substr("_t", F.col("cut") + 1)).alias("_id"))
    return join_counted(tails, ids, ["_id"], "left_semi").groupBy("_key").agg(F.min("cut").alias("cut"))


def known_tails(records: DataFrame, library: DataFrame, text: Column, most: int | None, least: int = 0) -> DataFrame:
    """Adds cut (``smallest_cuts``); null for none."""
    x = records.withColumn("_key", F.monotonically_increasing_id()) if "_key" not in records.columns else records
    return x.join(smallest_cuts(x, library, text, most, least), "_key", "left")


def learn_width(records: DataFrame, library: DataFrame, order: str = "line_no", content: str = "content", template: str = "eventtemplate") -> DataFrame:
    """One row: width of the timestamp (0: none, -1: the log is of another kind) and the line it was learnt from.

    Of the first line whose template, less at most MAX_WIDTH characters, is in the library, the width is where the first
    word of that rest stands in the content.
    """
    x = records.select(F.col(order).alias("_key"), F.col(content).alias("c"), F.col(template).alias("t"))
    x = known_tails(x, library, F.col("t"), MAX_WIDTH).where("cut IS NOT NULL")
    word = F.concat(F.element_at(F.split(F.ltrim(F.substr("t", F.col("cut") + 1)), r"\s+"), 1), F.lit(" "))
    x = x.withColumn("width", F.when(F.col("cut") == 0, F.lit(0)).otherwise(F.position(word, F.col("c")) - 1)).where("width >= 0")
    best = x.agg(F.min_by(F.struct("width", F.col("_key").alias("line")), "_key").alias("best"))
    return best.select(F.coalesce("best.width", F.lit(-1)).alias("width"), F.col("best.line").alias("line"))


class Torn:
    """Repair as a machine. A state is a head that is held back and how many records ago it was cut, or None.

    What a held head is makes no difference to what is left behind the next unknown record, so a block is run ahead
    from two beginnings: with no head, and with one that has no text.
    """

    reads, writes = ("eventidold", "eventtemplate", "_cut"), "eventtemplate"
    start, beginnings = None, [None, (None, 0)]

    def __init__(self, log: LogType) -> None:
        self.heads, self.special, self.reach = log.torn_heads, set(log.torn_special), log.scan_range

    def run(self, rows: list[tuple], state: tuple | None) -> tuple[list, list[bool], tuple | None]:
        out, stays = [], []
        for old, t, cut in rows:
            stay = True
            if state is not None:
                state = (state[0], state[1] + 1)
            if old != "0":
                new = t
            elif state is not None:
                new = (state[0] or "") + t if state[1] <= self.reach else t
                state = None
            elif t[:1] not in self.heads:
                new = t
            elif cut is None:
                # no rest is known: another writer's line begins in the next one
                new, stay, state = None, False, (t, 0)
            else:
                new = t[cut:]
                state = (t[: cut - 1] if hashlib.md5(new.encode()).hexdigest()[:8] in self.special else t[:cut], 0)
            out.append(new)
            stays.append(stay)
        return out, stays, state

    def ends(self, rows: list[tuple], states: list) -> list:
        return [self.run(rows, s)[2] for s in states]

    def behind(self, ends: list, state: tuple | None) -> tuple | None:
        if state is None:
            return ends[0]
        held = ends[1]
        return (state[0], state[1] + held[1]) if held is not None and held[0] is None else held


def repair_torn(records: DataFrame, library: DataFrame, log: LogType, order: str = "line_no", bits: int = 14) -> DataFrame:
    """Records (file_id, order, eventidold, eventtemplate, ...) with torn ones repaired.

    Of an unknown template (eventidold '0') that begins with a character of the log type's list, the smallest head is
    cut whose rest is a known template: the rest stays in its place, and the head is put before the next unknown one
    within the log type's range, known ones counted. If no rest is known the whole of it is a head. Records go by
    in order, in blocks of order numbers (``folds``). Each different text is looked for in the library once.
    """
    x = materialise(records)
    texts = x.where(F.col("eventidold") == "0").select(F.col("eventtemplate").alias("_key"))
    texts = texts.where(F.left("_key", F.lit(1)).isin(*log.torn_heads)).distinct()
    cuts = materialise(smallest_cuts(texts, library, F.col("_key"), None, 1).select(F.col("_key").alias("eventtemplate"), F.col("cut").alias("_cut")))
    x = join_counted(x, cuts, ["eventtemplate"], "left").select(*records.columns, "_cut")
    return folded(x, Torn(log), order=order, bits=bits).drop("_cut")
