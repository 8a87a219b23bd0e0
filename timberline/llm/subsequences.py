"""Ordered patterns of events that many sequences share, gaps allowed, by last-position induction.

For every (sequence, item) the last position is computed once. A sequence that holds a prefix, with its earliest
end at position e, holds the prefix extended by an item exactly if the item's last position exceeds e: support is
counted without scanning positions. Only extensions that are frequent get their new earliest end, the first
position of the item after e, from the positions stored in blocks.

An extension of a prefix by two items is only frequent if those by each of them are, so a pattern hands its frequent
extensions down: its children try their siblings' items, no others.

Everything is a relation: ends (sequence, pattern, end), lasts (sequence, item, last), positions (sequence, item, block,
sorted positions), and per level the patterns and the items to try. No sequence is ever one row, so one that holds a
third of all records is spread like the others: it has at most one last position per item, one end per pattern, and
blocks of bounded size; joins are by (sequence, item). Counts are combined before their shuffle. The driver holds no
pattern, only how many a level has.

Defined results: rows without a sequence, a position or an item (null or blank) are left out; equal rows count once; a
pattern has no step twice; a pattern is maximal if no frequent pattern of one step more contains it (which is the same
as no longer one, since all parts of a frequent pattern are frequent); an empty table gives no pattern.
"""

from __future__ import annotations

from decimal import ROUND_CEILING, Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.plans.shared import block_of, join_counted, materialise, release
from timberline.plans.tables import event_records


def frequent_subsequences(rows: DataFrame, sequence: str, order: str, item: str, min_share: str = "0.04", max_item_share: str = "0.30", bits: int = 14) -> DataFrame:
    """All frequent patterns of distinct steps: steps, sequences (their support), maximal.

    rows are distinct (sequence, order, item). ``min_share`` of all sequences must hold a pattern; items found in
    ``max_item_share`` of them or more are no steps.
    """
    # positions of a sequence's items, in blocks: bounded arrays, combined before the shuffle
    positions = rows.select(F.col(sequence).alias("sequence"), F.col(item).alias("item"), F.col(order).cast("long").alias("pos"))
    positions = positions.groupBy("sequence", "item", block_of(F.col("pos"), bits).alias("block")).agg(F.sort_array(F.collect_list("pos")).alias("at"))
    positions = materialise(positions)
    n = positions.agg(F.count_distinct("sequence").alias("n")).first()["n"]
    need = max(1, int((Decimal(min_share) * n).to_integral_value(ROUND_CEILING)))
    below = Decimal(max_item_share) * n
    lasts = positions.groupBy("sequence", "item").agg(F.max(F.element_at("at", -1)).alias("last"), F.min(F.col("at")[0]).alias("first"))
    counts = lasts.groupBy("item").agg(F.count(F.lit(1)).alias("sequences"))
    items = counts.where((F.col("sequences") >= need) & (F.col("sequences") < F.lit(below).cast("decimal(30,6)")))
    level = materialise(items.select(F.monotonically_increasing_id().alias("pattern"), F.array("item").alias("steps"), "item", "sequences"))
    size, found, tries = level.count(), [level], None
    if size:
        names = level.select("pattern", "item")
        lasts = materialise(join_counted(lasts, names, ["item"], rows=size))
        kept = materialise(join_counted(positions, names.select("item"), ["item"], rows=size))
        ends = materialise(lasts.select("sequence", "pattern", F.col("first").alias("end")))
        lasts = lasts.select("sequence", "item", "last")
    while size:
        if tries is None:
            # single items try all others of their sequences
            x = join_counted(ends.join(lasts, "sequence"), names.withColumnRenamed("item", "own"), ["pattern"], rows=size)
            x = x.where((F.col("item") != F.col("own")) & (F.col("last") > F.col("end")))
        else:
            x = join_counted(ends, tries, ["pattern"], rows=n_tries).join(lasts, ["sequence", "item"]).where(F.col("last") > F.col("end"))
        grown = x.groupBy("pattern", "item").agg(F.count(F.lit(1)).alias("sequences")).where(F.col("sequences") >= need)
        grown = materialise(grown.withColumn("longer", F.monotonically_increasing_id()))
        size = grown.count()
        if not size:
            break
        # only frequent extensions get the first position after the end, from the blocks that may have it
        x = join_counted(ends, grown.select("pattern", "item", "longer"), ["pattern"], rows=size).join(kept, ["sequence", "item"]).where(F.col("block") >= block_of(F.col("end"), bits))
        after = F.array_min(F.filter("at", lambda p: p > F.col("end")))
        x = x.groupBy("sequence", F.col("longer").alias("pattern")).agg(F.min(after).alias("end")).where("end IS NOT NULL")
        before, ends = ends, materialise(x)
        release(before)
        siblings = grown.select("pattern", F.col("item").alias("other"))
        tries = grown.select("pattern", "item", "longer").join(siblings, "pattern").where(F.col("item") != F.col("other"))
        tries = materialise(tries.select(F.col("longer").alias("pattern"), F.col("other").alias("item")))
        n_tries = tries.count()
        level = join_counted(grown, level.select("pattern", "steps"), ["pattern"]).select(F.col("longer").alias("pattern"), F.concat("steps", F.array("item")).alias("steps"), "item", "sequences")
        level = materialise(level)
        found.append(level)
    result = reduce(DataFrame.unionByName, found).select("steps", "sequences")
    # what a longer frequent pattern holds: it without any one of its steps
    at = F.explode(F.sequence(F.lit(1), F.size("steps")))
    parts = result.where(F.size("steps") > 1).select("steps", at.alias("drop"))
    parts = parts.select(F.filter("steps", lambda s, i: i != F.col("drop") - 1).alias("steps")).distinct().withColumn("held", F.lit(True))
    return result.join(parts, "steps", "left").select("steps", "sequences", F.col("held").isNull().alias("maximal"))


def session_patterns(log: DataFrame, **options) -> DataFrame:
    """Frequent patterns of the eventids of sessions, in lineid order."""
    return frequent_subsequences(event_records(log), "session_id", "lineid", "eventid", **options)
