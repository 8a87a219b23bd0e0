"""Counts of right and wrong answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: tp, fp, tn, fn, precision, recall, f1; shares with nothing below the line are 0."""
    y, p = F.coalesce(F.col(label), F.lit(0)) == 1, F.coalesce(F.col(predicted), F.lit(0)) == 1
    x = rows.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in (("tp", y & p), ("fp", ~y & p), ("tn", ~y & ~p), ("fn", y & ~p))])
    precision, recall = _share(F.col("tp"), F.col("tp") + F.col("fp")), _share(F.col("tp"), F.col("tp") + F.col("fn"))
    return x.select("*", precision.alias("precision"), recall.alias("recall"), _share(2 * precision * recall, precision + recall).alias("f1"))


def accuracy(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: n, right, accuracy."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col(label) == F.col(predicted)).cast("long")), F.lit(0)).alias("right")).withColumn("accuracy", _share(F.col("right"), F.col("n")))
