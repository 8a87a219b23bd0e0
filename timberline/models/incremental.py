"""Classifiers that learn on from batch to batch, on vectors: additive naive Bayes, perceptron, SGD.

All have partial_fit and transform, which adds prediction (0.0 or 1.0); what they have learnt is a small table or array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.models import bayes
from timberline.models.linear import LinearLearner
from timberline.plans.shared import materialise

#: Names, and the loss of those that are linear.
LOSSES = {"perceptron": "perceptron", "sgd_hinge": "hinge", "sgd_log": "log"}
NAMES = ["bayes", *LOSSES]


@dataclass
class Bayes:
    """Gaussian naive Bayes: the statistics of batches add up."""

    key: list[str]
    stats: DataFrame | None = None

    def _cells(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.key, F.posexplode(vector_to_array("features")).alias("idx", "value")).where("value <> 0")

    def partial_fit(self, rows: DataFrame) -> Bayes:
        new = bayes.statistics(self._cells(rows), rows.select(*self.key, F.col("label").cast("int").alias("label")))
        self.stats = materialise(new if self.stats is None else bayes.added(self.stats, new))
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        p = bayes.predicted(self._cells(rows), rows.select(*self.key, "label"), bayes.fitted(self.stats))
        return rows.join(p.select(*self.key, F.col("predicted").cast("double").alias("prediction")), self.key)


@dataclass
class Linear:
    """A perceptron or SGD on features as they are."""

    learner: LinearLearner

    def partial_fit(self, rows: DataFrame) -> Linear:
        self.learner.partial_fit(rows.select(vector_to_array("features").alias("features"), "label"))
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        x = self.learner.transform(rows.withColumn("_vector", F.col("features")).withColumn("features", vector_to_array("features")))
        return x.withColumn("features", F.col("_vector")).withColumn("prediction", F.col("predicted").cast("double")).drop("_vector", "margin", "predicted")


def learner(name: str, key: list[str], size: int) -> Bayes | Linear:
    """An unfitted learner for rows of ``key``, features of ``size`` and label."""
    if name == "bayes":
        return Bayes(key)
    return Linear(LinearLearner(size, LOSSES[name]))


def save(model: Bayes | Linear, folder: str, spark: SparkSession) -> None:
    if isinstance(model, Bayes):
        model.stats.write.mode("overwrite").parquet(folder)
    else:
        m = model.learner
        spark.createDataFrame([(m.loss, m.size, m.seen, m.weights.tolist())], "loss string, size int, seen int, weights array<double>").write.mode("overwrite").parquet(folder)


def load(name: str, key: list[str], folder: str, spark: SparkSession) -> Bayes | Linear:
    import numpy as np

    x = spark.read.parquet(folder)
    if name == "bayes":
        # read at once: the folder may be written anew by what goes on learning
        return Bayes(key, materialise(x))
    r = x.first()
    return Linear(LinearLearner(r["size"], r["loss"], weights=np.array(r["weights"]), seen=r["seen"]))
