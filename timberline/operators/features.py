"""One row per entity with count, last line and totals of each event type, for a fixed list of types.

The records are reduced to numbers (type index, line, length); copies of a line number fall together by a hash
aggregation that combines before its shuffle. Counts, sums and maxima per (entity, type) are combined before the
shuffle too, so an entity of any size arrives as at most one row per type. One grouped pass of conditional count, sum
and maximum expressions over the fixed list, without a further shuffle, makes the wide rows of them. The list is
taken in groups of SLOTS types: a row is only asked which slot of its group it is, so the pass has 3 * SLOTS
conditional expressions however long the list, few enough to be compiled; the groups of an entity, which lie in the same
partition, are then set side by side.

The wide table has as many partitions as its cells ask for, known by counting the entities of the written long form.

Defined results: records without an entity or a line number count nowhere; records without an event, or with one that
is not in the list, count in the totals over all records only; an entity that never has a type gets count 0, total
0 and no last line for it; an empty table gives no row; copies that differ count once, with the greatest values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.plans.shared import BROADCAST_ROWS, materialise

#: Types in one wide table at most; beyond that the long form (entity, type) is the right shape.
MAX_TYPES = 4_000
#: Types of a group, and cells of the wide table in one partition.
SLOTS = 16
CELLS = 4_000_000


def event_types(library: DataFrame) -> list[str]:
    """The fixed type list: distinct eventids of a template library, in order."""
    rows = library.select("eventid").where(F.trim("eventid") != "").distinct().orderBy("eventid").limit(MAX_TYPES + 1).collect()
    if len(rows) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types; use the long form")
    return [r["eventid"] for r in rows]


def typed_records(df: DataFrame, types: list[str], entities: list[str]) -> DataFrame:
    """One row of numbers per line number: the entities, kind (index in types or null), chars, abnormal."""
    spark = df.sparkSession
    assert len(types) <= BROADCAST_ROWS
    kinds = spark.createDataFrame(list(zip(types, range(len(types)))), "eventid string, kind int")
    x = df.where(F.col("lineid").isNotNull()).select(
        *entities, "lineid", "eventid", F.coalesce(F.length("content"), F.lit(0)).alias("chars"), F.coalesce(F.col("label"), F.lit(0)).alias("abnormal")
    )
    x = x.join(F.broadcast(kinds), "eventid", "left")
    # all values have a fixed width: a hash aggregation, combined before the shuffle
    return x.groupBy("lineid").agg(*[F.max(e).alias(e) for e in entities], F.max("kind").alias("kind"), F.max("chars").alias("chars"), F.max("abnormal").alias("abnormal"))


def feature_table(records: DataFrame, types: list[str], entity: str) -> DataFrame:
    """The wide table: records, events, last_line, chars, abnormal over all, then n_, last_ and chars_ by type."""
    x = records.where(F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), F.coalesce("kind", F.lit(-1)).alias("kind"), "lineid", "chars", "abnormal")
    # combined before the shuffle: of each (entity, type) one row is left
    x = materialise(x.groupBy("entity", "kind").agg(F.expr("count(1) n"), F.expr("max(lineid) last"), F.expr("sum(chars) chars"), F.expr("sum(abnormal) abnormal")))
    cells = x.select("entity").distinct().count() * (3 * len(types) + 6)
    parts = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(cells / CELLS))
    x = x.repartition(parts, "entity").withColumns({"grp": F.expr(f"CAST(floor(kind / {SLOTS}) AS INT)"), "slot": F.expr(f"pmod(kind, {SLOTS})")})
    slots = range(min(SLOTS, len(types)))
    conditional = [e for s in slots for e in (f"sum(CASE WHEN slot = {s} THEN n END) n{s}", f"max(CASE WHEN slot = {s} THEN last END) last{s}", f"sum(CASE WHEN slot = {s} THEN chars END) chars{s}")]
    x = x.groupBy("entity", "grp").agg(*[F.expr(e) for e in conditional], F.expr("sum(n) n"), F.expr("max(last) last"), F.expr("sum(chars) chars"), F.expr("sum(abnormal) abnormal"))
    # one row per (entity, group): an entity's groups side by side
    group = "struct(" + ", ".join(f"n{s}, last{s}, chars{s}" for s in slots) + ")"
    beside = ["sum(n) records", "coalesce(sum(CASE WHEN grp >= 0 THEN n END), 0) events", "max(last) last_line", "sum(chars) chars", "sum(abnormal) abnormal"]
    beside += [f"first(CASE WHEN grp = {g} THEN {group} END, true) g{g}" for g in range(math.ceil(len(types) / SLOTS))]
    x = x.groupBy("entity").agg(*[F.expr(e) for e in beside])
    wide = [F.col("entity").alias(entity), "records", "events", "last_line", "chars", "abnormal"]
    for k, t in enumerate(types):
        g, s = divmod(k, SLOTS)
        wide += [F.coalesce(f"g{g}.n{s}", F.lit(0)).alias(f"n_{t}"), F.col(f"g{g}.last{s}").alias(f"last_{t}"), F.coalesce(f"g{g}.chars{s}", F.lit(0)).alias(f"chars_{t}")]
    return x.select(*wide)


def event_features(df: DataFrame, library: DataFrame, entity: str) -> DataFrame:
    """The feature table of ``entity`` (session_id, file_id) over the types of ``library``."""
    types = event_types(library)
    return feature_table(typed_records(df, types, [entity]), types, entity)
