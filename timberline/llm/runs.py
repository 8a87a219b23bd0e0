"""Runs of the same or nearly the same successive events, each collapsed into one event, by pointer doubling.

Every record that says the same as its predecessor in the sequence points to it; all others point to themselves.
Then pointers are replaced by their pointers' pointers, in as many self-joins as the logarithm of the longest run,
until all reach the start of their run. Only records whose pointer has not arrived take part in a round, and each
round is written to the shared folder, so the plan stays short and the loss of an executor costs one round.

The predecessor comes from windows over (sequence, block of positions), never over a whole sequence, so a sequence of
any length is many bounded windows; the first record of a block finds its predecessor among the blocks' last ones,
which takes two rows of each block of the sequences that have several.

Defined results: records without sequence, position or event (null or blank) are passed over and break nothing; equal
rows of one position count once (of unequal ones the greatest event); events are the same if their ids are equal, or
their templates without blanks, letter case and punctuation, wildcards kept; a record without template only equals
its own id; duration is latest less earliest stated time of the run, null if none is stated; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.times import time_millis
from timberline.plans.shared import block_of, materialise
from timberline.plans.tables import event_records


def saying(template: Column) -> Column:
    """What a template says: lower case letters and digits, and its wildcards."""
    return F.regexp_replace(F.regexp_replace(F.lower(template), r"<\*>", "\x01"), r"[^\p{L}\p{N}\x01]+", "")


def _pointers(rows: DataFrame, bits: int) -> DataFrame:
    """pos, ptr (the predecessor), sequence, low, high (times of both) of each record that equals its predecessor."""
    w = Window.partitionBy("sequence", "block").orderBy("pos", F.desc("event"), F.desc("said"), F.desc("ts"))
    x = rows.withColumn("block", block_of(F.col("pos"), bits)).select("*", F.lag("pos").over(w).alias("copy"))
    x = x.where(F.col("copy").isNull() | (F.col("copy") != F.col("pos"))).drop("copy")
    w = Window.partitionBy("sequence", "block").orderBy("pos")
    before = F.lag(F.struct("pos", "event", "said", "ts")).over(w)
    x = x.select("*", before.alias("before"), F.lead("pos").over(w).isNull().alias("final"))
    p = F.col("before")
    same = F.coalesce(F.col("event") == p["event"], F.lit(False)) | F.coalesce(F.col("said") == p["said"], F.lit(False))
    edge = p.isNull() | F.col("final")
    x = materialise(x.where(same | edge).select("sequence", "block", "pos", "event", "said", "ts", "before", same.alias("same"), edge.alias("edge")))
    columns = ["sequence", "pos", p["pos"].alias("ptr"), F.least("ts", p["ts"]).alias("low"), F.greatest("ts", p["ts"]).alias("high")]
    # records at the edges of blocks, of sequences with more than one block
    edges = x.where("edge")
    wide = edges.groupBy("sequence").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select("sequence")
    w = Window.partitionBy("sequence").orderBy("pos")
    edges = edges.join(wide, "sequence").withColumn("before", F.coalesce("before", F.lag(F.struct("pos", "event", "said", "ts")).over(w)))
    over = edges.where(~F.col("same") & p.isNotNull() & same)
    # a block's last record already has its predecessor; only firsts got one here
    return x.where("same").select(*columns).unionByName(over.select(*columns))


def pointers_to_starts(active: DataFrame) -> DataFrame:
    """Doubles the pointers of (sequence, pos, ptr, low, high) until all reach records that point nowhere."""
    columns = ["sequence", "pos", "ptr", "low", "high"]
    done: list[DataFrame] = []
    while True:
        targets = active.select("sequence", "pos", "ptr")
        for d in done:
            targets = targets.unionByName(d.select("sequence", "pos", "ptr"))
        targets = targets.select("sequence", F.col("pos").alias("ptr"), F.col("ptr").alias("further"))
        x = active.join(targets, ["sequence", "ptr"], "left")
        x = materialise(x.select("sequence", "pos", F.coalesce("further", "ptr").alias("ptr"), "low", "high", F.col("further").isNull().alias("arrived")))
        done.append(x.where("arrived").select(*columns))
        active = x.where("NOT arrived").select(*columns)
        if active.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def runs(rows: DataFrame, bits: int = 16) -> DataFrame:
    """Runs of at least two records: sequence, first, last, n, low, high (latest and earliest stated time).

    rows: sequence, pos, event, said, ts.
    """
    return _collapsed(materialise(_pointers(rows, bits)))


def _collapsed(pointers: DataFrame) -> DataFrame:
    x = pointers_to_starts(pointers)
    # one long run is combined before the shuffle
    return x.groupBy("sequence", F.col("ptr").alias("first")).agg(F.max("pos").alias("last"), (F.count(F.lit(1)) + 1).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def session_events(log: DataFrame) -> DataFrame:
    """sequence, pos, event, said, ts of the distinct records of sessions that have an event."""
    x = event_records(log, F.coalesce(saying(F.col("eventtemplate")), F.lit("")).alias("said"), time_millis(F.col("time")).alias("ts"))
    return x.select(F.col("session_id").alias("sequence"), F.col("lineid").alias("pos"), F.col("eventid").alias("event"), F.when(F.col("said") != "", F.col("said")).alias("said"), "ts")


def session_runs(log: DataFrame) -> DataFrame:
    """Runs of at least two records of each session: session_id, lineid_first, lineid_last, n, duration_ms."""
    r = runs(session_events(log))
    return r.select(F.col("sequence").alias("session_id"), F.col("first").alias("lineid_first"), F.col("last").alias("lineid_last"), "n", (F.col("high") - F.col("low")).alias("duration_ms"))


def collapsed_sessions(log: DataFrame) -> DataFrame:
    """All events of the sessions, each run as one: session_id, lineid_first, lineid_last, eventid, n, duration_ms."""
    rows = session_events(log)
    pointers = materialise(_pointers(rows, 16))
    w = Window.partitionBy("sequence", "pos").orderBy(F.desc("event"), F.desc("said"), F.desc("ts"))
    heads = rows.join(pointers.select("sequence", "pos"), ["sequence", "pos"], "left_anti").withColumn("k", F.row_number().over(w)).where("k = 1")
    x = heads.join(_collapsed(pointers).withColumnRenamed("first", "pos"), ["sequence", "pos"], "left")
    return x.select(
        F.col("sequence").alias("session_id"), F.col("pos").alias("lineid_first"), F.coalesce("last", "pos").alias("lineid_last"), F.col("event").alias("eventid"),
        F.coalesce("n", F.lit(1)).alias("n"), F.coalesce(F.col("high") - F.col("low"), F.when(F.col("ts").isNotNull(), F.lit(0))).alias("duration_ms"),
    )
