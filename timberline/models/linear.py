"""Linear classifiers that learn on, batch after batch: perceptron, SGD with hinge or logistic loss.

One pass over the partitions averages the partitions' weights (each starts from the current ones), so a batch of any
size is learnt in parallel; the next batch goes on from the result, which is a small array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.plans.shared import ship


#: Rows whose gradients are added up before a step.
BATCH = 8


@dataclass
class LinearLearner:
    """loss: perceptron, hinge or log. Rows: features (array<double>), label (0 or 1)."""

    size: int
    loss: str = "hinge"
    rate: float = 0.05
    penalty: float = 1e-4
    epochs: int = 5
    seed: int = 3
    weights: np.ndarray = field(default=None)
    seen: int = 0

    def __post_init__(self) -> None:
        if self.loss not in ("perceptron", "hinge", "log"):
            raise ValueError("loss is perceptron, hinge or log")
        if self.weights is None:
            self.weights = np.zeros(self.size + 1)

    def _epoch(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """One pass over rows in seeded order, BATCH of them at a time: the mean gradient of each batch at once."""
        order = np.random.default_rng(self.seed).permutation(len(x))
        for at in np.array_split(order, max(1, len(x) // BATCH)):
            t = 2 * y[at] - 1
            z = t * (x[at] @ w[:-1] + w[-1])
            if self.loss == "log":
                g = -t / (1 + np.exp(np.clip(z, -30, 30)))
            else:
                g = np.where(z <= (1 if self.loss == "hinge" else 0), -t, 0.0)
            if self.loss != "perceptron":
                w[:-1] *= (1 - self.rate * self.penalty) ** len(at)
            w[:-1] -= self.rate * (g @ x[at])
            w[-1] -= self.rate * g.sum()
        return w

    def partial_fit(self, batch: DataFrame) -> LinearLearner:
        """Learns on from a batch."""
        ship(batch.sparkSession)
        data = batch.select("features", F.col("label").cast("double").alias("label"))
        for _ in range(self.epochs):
            start, epoch = self.weights, self._epoch

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                w, n = start.copy(), 0
                for b in batches:
                    if len(b):
                        w, n = epoch(np.stack(b["features"].to_numpy()), b["label"].to_numpy(), w), n + len(b)
                if n:
                    yield pd.DataFrame({"w": [w.tolist()], "n": [n]})

            # one row of weights per partition, summed by position
            parts = data.mapInPandas(run, "w array<double>, n long").select(F.posexplode("w").alias("k", "w"), "n")
            means = parts.groupBy("k").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).collect()
            for r in means:
                self.weights[r["k"]] = r["w"]
        self.seen += 1
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds margin and predicted."""
        w = F.array(*[F.lit(float(v)) for v in self.weights[:-1]])
        margin = F.aggregate(F.zip_with("features", w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) + F.lit(float(self.weights[-1]))
        return rows.withColumn("margin", margin).withColumn("predicted", (F.col("margin") > 0).cast("int"))
