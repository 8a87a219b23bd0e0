"""Count matrices in long form (instance, event, value) and their weightings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.plans.shared import join_counted, with_vectors

#: Fixed value: keeps the document frequency from being zero.
SMALL = 1e-8


def count_matrix(members: DataFrame, instance: list[str], event: str = "idx") -> DataFrame:
    """instance, event, n: counts combined before the shuffle."""
    return members.groupBy(*instance, event).agg(F.count(F.lit(1)).alias("n"))


def idf(matrix: DataFrame, instances: int, event: str = "idx") -> DataFrame:
    """event, df, idf = ln(instances / (df + 1e-8)). Fitted once, used again for new data."""
    x = matrix.groupBy(event).agg(F.count(F.lit(1)).alias("df"))
    return x.withColumn("idf", F.log(F.lit(float(instances)) / (F.col("df") + F.lit(SMALL))))


def tf_idf(matrix: DataFrame, fitted: DataFrame, event: str = "idx") -> DataFrame:
    """Adds value = n * idf; events that weren't seen when the idf was fitted have value 0 and are left out."""
    return join_counted(matrix, fitted.select(event, "idf"), [event]).withColumn("value", F.col("n") * F.col("idf"))


def zero_mean(matrix: DataFrame, instances: int, event: str = "idx", value: str = "n") -> DataFrame:
    """Adds centred: value less the event's mean over all instances. Absent cells of an event are -mean, one row each."""
    means = matrix.groupBy(event).agg((F.sum(value) / F.lit(float(instances))).alias("mean"))
    return join_counted(matrix, means, [event]).withColumn("centred", F.col(value) - F.col("mean"))


def sigmoid(matrix: DataFrame, value: str = "n") -> DataFrame:
    """Adds squashed: 1 / (1 + e^-value) of the cells that are there; absent ones stay 0."""
    return matrix.withColumn("squashed", 1 / (1 + F.exp(-F.col(value))))


def vectors(matrix: DataFrame, instances: DataFrame, instance: list[str], size: int, event: str = "idx", value: str = "n") -> DataFrame:
    """The instances with one sparse vector each, for MLlib; those without a cell have one without entries.

    A row holds its cells only, at most ``size``.
    """
    cells = F.array_sort(F.collect_list(F.struct(F.col(event).cast("int").alias("i"), F.col(value).cast("double").alias("v"))))
    x = instances.join(matrix.groupBy(*instance).agg(cells.alias("_cells")), instance, "left")
    entry = lambda f: F.coalesce(F.transform("_cells", lambda c: c[f]), F.array())
    return with_vectors(x, size, entry("i"), entry("v")).drop("_cells")
