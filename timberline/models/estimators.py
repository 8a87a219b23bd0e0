"""Classifiers of MLlib under one name each, with the settings this engine uses.

l1-penalised linear support vectors don't exist in MLlib: the l2 form stands in. Trees are as deep as MLlib allows.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.plans.shared import join_counted

NAMES = ["tree", "forest", "logistic", "vectors", "forest_multi", "logistic_multi", "vectors_multi"]


def estimator(name: str, rows: int, features: str = "features", label: str = "label", seed: int = 5):
    """An unfitted classifier for so many rows."""
    shared = {"featuresCol": features, "labelCol": label}
    if name == "tree":
        return DecisionTreeClassifier(maxDepth=30, seed=seed, **shared)
    if name in ("forest", "forest_multi"):
        return RandomForestClassifier(numTrees=100, maxDepth=30 if name == "forest" else 15, seed=seed, **shared)
    if name in ("logistic", "logistic_multi"):
        # strength 100 over all rows
        return LogisticRegression(regParam=1 / (100 * max(rows, 1)), standardization=False, family="multinomial" if name == "logistic_multi" else "auto", **shared)
    if name == "vectors":
        return LinearSVC(regParam=1 / (100 * max(rows, 1)), standardization=False, **shared)
    if name == "vectors_multi":
        return OneVsRest(classifier=LinearSVC(standardization=False), **shared)
    raise ValueError(f"one of {NAMES}")


def leave_one_out(data: DataFrame, name: str, key: str, label: str = "label") -> DataFrame:
    """key, label, predicted: each row by a model of all others. For samples, which are few."""
    keys = [r[key] for r in data.select(key).distinct().orderBy(key).collect()]
    out = None
    for k in keys:
        model = estimator(name, len(keys), label=label).fit(data.where(F.col(key) != k))
        x = model.transform(data.where(F.col(key) == k)).select(key, label, F.col("prediction").cast("int").alias("predicted"))
        out = x if out is None else out.unionByName(x)
    return out


def class_probabilities(model: Model, rows: DataFrame, key: list[str]) -> DataFrame:
    """key, class_index, probability for every class."""
    x = model.transform(rows)
    return x.select(*key, F.posexplode(vector_to_array("probability")).alias("class_index", "probability"))


def top_classes(probabilities: DataFrame, key: list[str], k: int = 3) -> DataFrame:
    """The k most probable classes of each row with their rank; ties go to the smaller class."""
    w = Window.partitionBy(*key).orderBy(F.desc("probability"), "class_index")
    return probabilities.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def diagnosis(top: DataFrame, index_to_class: DataFrame, classes: DataFrame) -> DataFrame:
    """Top classes with their labels, references and descriptions."""
    return join_counted(join_counted(top, index_to_class, ["class_index"]), classes, ["class_label"], "left")


def next_event_network(width: int, vocabulary: int, hidden: int = 128, epochs: int = 50, seed: int = 5, batch: int = 32, inputs: int | None = None) -> MultilayerPerceptronClassifier:
    """A feed-forward network from sequences to the next event, one-hot or of so many plain ``inputs``. It is not recurrent.

    ``batch`` is the number of rows that are computed at once.
    """
    layers = [inputs or width * vocabulary, hidden, vocabulary]
    return MultilayerPerceptronClassifier(layers=layers, maxIter=epochs, seed=seed, blockSize=batch, featuresCol="features", labelCol="target")


def network_ranks(model: Model, sequences: DataFrame, k: int) -> DataFrame:
    """Adds rank of the target among all events by the network's probability (ties to the smaller number), and anomalous."""
    x = model.transform(sequences).withColumn("_p", vector_to_array("probability"))
    mine = F.element_at("_p", F.col("target").cast("int") + 1)
    before = F.filter("_p", lambda v, i: (v > mine) | ((v == mine) & (i < F.col("target"))))
    x = x.withColumn("rank", F.size(before) + 1).withColumn("anomalous", (F.col("rank") > k).cast("int"))
    return x.drop("_p", "features", "rawPrediction", "probability", "prediction")


def plane(vectors: DataFrame, key: list[str]) -> DataFrame:
    """key, x, y: the two principal components of each row's features, for a look at how samples lie."""
    from pyspark.ml.feature import PCA

    x = PCA(k=2, inputCol="features", outputCol="_plane").fit(vectors).transform(vectors).withColumn("_plane", vector_to_array("_plane"))
    return x.select(*key, F.col("_plane")[0].alias("x"), F.col("_plane")[1].alias("y"))
