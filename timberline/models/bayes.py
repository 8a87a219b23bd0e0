"""Gaussian naive Bayes from additive statistics: batches are added up, exactly."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: part of the largest variance that is added to every variance.
SMOOTHING = 1e-9


def statistics(cells: DataFrame, instances: DataFrame, label: str = "label", event: str = "idx", value: str = "value") -> DataFrame:
    """label, event, n (instances of the class), s, ss: sums over the cells that are there; absent cells are zero.

    cells: instance columns, event, value. instances: instance columns, label. They join on the columns they share.
    """
    on = [c for c in instances.columns if c in cells.columns and c != label]
    n = instances.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    sums = cells.join(instances, on).groupBy(label, event).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    # classes and events are few: classes are spread over the events
    classes = [r[label] for r in n.select(label).collect()]
    every = cells.select(event).distinct().withColumn(label, F.explode(F.array(*[F.lit(c) for c in classes]))).join(F.broadcast(n), label)
    x = every.join(sums, [label, event], "left")
    return x.select(label, event, "n", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("ss", F.lit(0.0)).alias("ss"))


def added(a: DataFrame, b: DataFrame, label: str = "label", event: str = "idx") -> DataFrame:
    """The statistics of two batches together."""
    classes = a.select(label, "n").distinct().unionByName(b.select(label, "n").distinct()).groupBy(label).agg(F.sum("n").alias("n"))
    sums = a.unionByName(b).groupBy(label, event).agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    return sums.join(classes, label).select(label, event, "n", "s", "ss")


def fitted(stats: DataFrame, label: str = "label", event: str = "idx") -> DataFrame:
    """label, event, prior, mean, var of statistics."""
    x = stats.withColumns({"mean": F.col("s") / F.col("n"), "var": F.greatest(F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n")), F.lit(0.0))})
    total = stats.select(label, "n").distinct().agg(F.sum("n")).first()[0] or 1
    # the floor: a small part of the largest variance of an event over all instances
    whole = stats.groupBy(event).agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    top = whole.agg(F.max(F.col("ss") / total - (F.col("s") / total) * (F.col("s") / total))).first()[0] or 1.0
    floor = max(SMOOTHING * top, 1e-12)
    return x.select(label, event, (F.col("n") / F.lit(float(total))).alias("prior"), "mean", (F.col("var") + F.lit(floor)).alias("var"))


def predicted(cells: DataFrame, instances: DataFrame, model: DataFrame, label: str = "label", event: str = "idx", value: str = "value") -> DataFrame:
    """Instance columns, predicted class and its log-likelihood; ties go to the smaller class.

    The likelihood of an all-zero instance is one number per class; cells only add their difference to it, so the
    work follows the cells that are there.
    """
    on = [c for c in instances.columns if c in cells.columns and c != label]
    at_zero = -0.5 * F.log(2 * math.pi * F.col("var")) - F.col("mean") * F.col("mean") / (2 * F.col("var"))
    base = model.groupBy(label).agg((F.log(F.max("prior")) + F.sum(at_zero)).alias("base"))
    classes = [(r[label], r["base"]) for r in base.collect()]  # one row per class
    diff = F.col("mean") * F.col("mean") / (2 * F.col("var")) - (F.col(value) - F.col("mean")) * (F.col(value) - F.col("mean")) / (2 * F.col("var"))
    m = model.select(F.col(label).alias("_class"), event, "mean", "var")
    more = cells.join(m, event).groupBy(*on, "_class").agg(F.sum(diff).alias("more"))
    every = instances.select(*on).withColumn("_k", F.explode(F.array(*[F.struct(F.lit(c).alias("_class"), F.lit(b).alias("base")) for c, b in classes]))).select(*on, "_k._class", "_k.base")
    x = every.join(more, [*on, "_class"], "left").withColumn("score", F.col("base") + F.coalesce("more", F.lit(0.0)))
    best = F.max_by(F.struct("_class", "score"), F.struct("score", -F.col("_class")))
    return x.groupBy(*on).agg(best.alias("b")).select(*on, F.col("b._class").alias("predicted"), F.col("b.score").alias("score"))
