"""Rows attached to the latest starting row before them, in groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.plans.shared import block_of, join_counted, materialise


def carried(df: DataFrame, group: str, order: str, value: Column, name: str, bits: int = 16) -> DataFrame:
    """Adds the latest non-null ``value`` at or before each row of its group, in ``order``.

    Windows run over (group, block of order); what earlier blocks hold comes from one row per block, so the big side
    is shuffled once, by (group, block), and no task gets a whole hot group.
    """
    x = df.withColumns({"_block": block_of(F.col(order), bits), "_value": value})
    w = Window.partitionBy(group, "_block").orderBy(order)
    x = x.withColumn("_own", F.last("_value", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tops = x.groupBy(group, "_block").agg(F.max_by("_own", order).alias("_top"))
    over = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(group, "_block", F.last("_top", True).over(over).alias("_before"))
    return x.join(tops, [group, "_block"], "left").withColumn(name, F.coalesce("_own", "_before")).drop("_block", "_value", "_own", "_top", "_before")


def running_sum(df: DataFrame, group: str, order: str, value: Column, name: str, bits: int = 16) -> DataFrame:
    """Adds the sum of ``value`` (whole numbers, null is 0) over the rows of the group at or before each, in ``order``."""
    x = df.withColumns({"_block": block_of(F.col(order), bits), "_value": F.coalesce(value.cast("long"), F.lit(0))})
    w = Window.partitionBy(group, "_block").orderBy(order)
    x = x.withColumn("_own", F.sum("_value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tops = x.groupBy(group, "_block").agg(F.sum("_value").alias("_top"))
    over = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(group, "_block", F.coalesce(F.sum("_top").over(over), F.lit(0)).alias("_before"))
    return x.join(tops, [group, "_block"], "left").withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_block", "_value", "_own", "_top", "_before")


def running_count(df: DataFrame, group: str, order: str, flag: Column, name: str, bits: int = 16) -> DataFrame:
    """Adds the number of rows with ``flag`` at or before each row of its group, in ``order``."""
    return running_sum(df, group, order, flag, name, bits)


def numbered(df: DataFrame, group: str, order: str, name: str, bits: int = 16) -> DataFrame:
    """Adds positions from 1 within each group, in ``order`` (unique in its group)."""
    return running_count(df, group, order, F.lit(True), name, bits)


def along(df: DataFrame, group: str, order: str, lasts: dict[str, Column], sums: dict[str, Column] | None = None, before: bool = False, bits: int = 16) -> DataFrame:
    """Adds latest values and sums as ``carried`` and ``running_sum`` do, all in one pass; ``before``: without the row itself.

    What earlier blocks hold comes from ``df`` itself, by columns that the values need: ``df`` should be a written table.
    """
    sums = sums or {}
    x = df.withColumns({"_block": block_of(F.col(order), bits)} | {f"_{n}": v for n, v in lasts.items()} | {f"_{n}": F.coalesce(v.cast("long"), F.lit(0)) for n, v in sums.items()})
    rows = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    tops = [x.where(F.col(f"_{n}").isNotNull()).groupBy(group, "_block").agg(F.max_by(f"_{n}", order).alias(n)) for n in lasts]
    # a block that holds no value still has those of the blocks before it
    tops.append(x.groupBy(group, "_block").agg(*[F.sum(f"_{n}").alias(n) for n in sums]) if sums else x.select(group, "_block").distinct())
    tops = reduce(lambda a, b: a.unionByName(b, True), tops).groupBy(group, "_block").agg(*[F.first(n, True).alias(n) for n in [*lasts, *sums]])
    over = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(group, "_block", *[(F.last(n, True) if n in lasts else F.sum(n)).over(over).alias(f"_before_{n}") for n in [*lasts, *sums]])
    x = x.withColumns({f"_own_{n}": (F.last(f"_{n}", True) if n in lasts else F.sum(f"_{n}")).over(rows) for n in [*lasts, *sums]})
    # blocks before which nothing is get nothing
    x = join_counted(x, materialise(tops.where(" OR ".join(f"_before_{n} IS NOT NULL" for n in [*lasts, *sums]))), [group, "_block"], "left")
    none = F.lit(0).cast("long")
    x = x.withColumns({n: F.coalesce(f"_own_{n}", f"_before_{n}") for n in lasts} | {n: F.coalesce(f"_own_{n}", none) + F.coalesce(f"_before_{n}", none) for n in sums})
    return x.drop("_block", *[f"{p}_{n}" for n in [*lasts, *sums] for p in ("", "_own", "_before")])
