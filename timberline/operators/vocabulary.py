"""Vocabularies: event ids with fixed places. Sizes are hundreds or thousands by nature, and places stay when ids come."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.plans.shared import join_counted

#: A free place, and the id that stands for all unknown ones in the last place.
FREE, UNKNOWN = "0", "ffffffff"


def room(library: DataFrame, size: int) -> int:
    """The size of a vocabulary that holds all ids of the library and the unknown one: ``size`` or more."""
    return max(size, library.select("eventid").where("eventid <> '0'").distinct().count() + 1)


def build(library: DataFrame, size: int, seed: str = "seed") -> DataFrame:
    """eventid, idx: the library's ids on seeded places, free places up to ``size``, the last place for unknown ids.

    A library of more ids than that makes the vocabulary larger; none is dropped.
    """
    spark, size = library.sparkSession, room(library, size)
    ids = library.select("eventid").where("eventid <> '0'").distinct().withColumn("free", F.lit(0))
    spare = spark.range(size - 1).select(F.concat(F.lit("free"), F.col("id").cast("string")).alias("eventid"), F.lit(1).alias("free"))
    # spare entries fill up what ids leave of size - 1 places, then all are shuffled by hash
    x = ids.unionByName(spare).withColumn("k", F.row_number().over(Window.orderBy("free", F.md5(F.concat("eventid", F.lit(seed))), "eventid"))).where(F.col("k") < size)
    x = x.withColumn("idx", F.row_number().over(Window.orderBy(F.md5(F.concat("eventid", F.lit(seed))), "eventid")) - 1)
    last = spark.createDataFrame([(UNKNOWN, size - 1)], "eventid string, idx int")
    return x.select(F.when(F.col("free") == 1, FREE).otherwise(F.col("eventid")).alias("eventid"), "idx").unionByName(last)


def static(library: DataFrame, seed: str = "seed") -> DataFrame:
    """eventid, idx: a seeded permutation of the library's ids, never updated."""
    ids = library.select("eventid").distinct()
    return ids.select("eventid", (F.row_number().over(Window.orderBy(F.md5(F.concat("eventid", F.lit(seed))), "eventid")) - 1).alias("idx"))


def insert(vocabulary: DataFrame, new_ids: DataFrame, seed: str = "seed") -> DataFrame:
    """Ids that the vocabulary lacks go to free places, both in seeded order. More ids than free places are an error."""
    lacking = new_ids.select("eventid").where("eventid <> '0'").distinct().join(vocabulary.select("eventid"), "eventid", "left_anti")
    wanted, there = lacking.count(), vocabulary.where(F.col("eventid") == FREE).count()
    if wanted > there:
        raise ValueError(f"{wanted} new ids, but {there} free places; build a larger vocabulary")
    lacking = lacking.withColumn("k", F.row_number().over(Window.orderBy(F.md5(F.concat("eventid", F.lit(seed))), "eventid"))).withColumnRenamed("eventid", "new")
    free = vocabulary.where(F.col("eventid") == FREE).withColumn("k", F.row_number().over(Window.orderBy(F.md5(F.concat(F.col("idx").cast("string"), F.lit(seed))), "idx")))
    placed = free.join(lacking, "k").select("idx", "new")
    return vocabulary.join(placed, "idx", "left").select(F.coalesce("new", "eventid").alias("eventid"), "idx")


def rename(vocabulary: DataFrame, library: DataFrame) -> DataFrame:
    """Places of old ids take the new ones (library: eventidold, eventid)."""
    changed = library.where("eventidold IS NOT NULL AND eventidold <> '0' AND eventidold <> eventid").groupBy(F.col("eventidold").alias("eventid")).agg(F.min("eventid").alias("new"))
    return vocabulary.join(changed, "eventid", "left").select(F.coalesce("new", "eventid").alias("eventid"), "idx")


def unknown_events(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Ids of records that the vocabulary lacks, with their records."""
    x = records.where("eventid IS NOT NULL").join(vocabulary.select("eventid"), "eventid", "left_anti")
    return x.groupBy("eventid").agg(F.count(F.lit(1)).alias("records"))


def indexed(records: DataFrame, vocabulary: DataFrame, last: int | None = None) -> DataFrame:
    """Adds idx; of unknown ids it is ``last`` (sequences), or they are left out (matrices)."""
    known = vocabulary.where(F.col("eventid") != FREE)
    if last is None:
        return join_counted(records, known, ["eventid"])
    return join_counted(records, known, ["eventid"], "left").withColumn("idx", F.coalesce("idx", F.lit(last)))
