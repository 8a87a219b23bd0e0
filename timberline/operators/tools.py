"""Small tools on tables of records and templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_library(library: DataFrame) -> DataFrame:
    return library.orderBy("eventid")


def duplicate_groups(rows: DataFrame, key: list[str], position: str) -> DataFrame:
    """Equal rows: key, copies, and their positions in order. The number of copies is combined before the shuffle."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.sort_array(F.collect_list(position)).alias("positions")).where("copies > 1")


def duplicate_members(rows: DataFrame, key: list[str], position: str, empty: tuple = ("", "0")) -> DataFrame:
    """Rows that have an equal: key, copies, position, one row each, so a group of any size stays spread.

    Copies are counted with a partial step before the shuffle; keys that are all empty (blank or 0) are passed over.
    """
    said = [~F.trim(F.col(k).cast("string")).isin(*empty) for k in key]
    x = rows.where(reduce(lambda a, b: a | b, said))
    n = x.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    on = reduce(lambda a, b: a & b, [F.col(f"x.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key])
    return x.alias("x").join(n.alias("n"), on).select(*[F.col(f"x.{k}") for k in key], "n.copies", F.col(f"x.{position}"))


def records_of(records: DataFrame, eventid: str) -> DataFrame:
    """Records of one event: lineid, place (time, or the line number)."""
    return records.where(F.col("eventid") == eventid).select("lineid", F.coalesce("time", F.col("lineid").cast("string")).alias("place"))
