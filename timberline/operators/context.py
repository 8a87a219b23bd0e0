"""Features of samples from the records around typical ones: by presence (binary) or by counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators.islands import numbered
from timberline.operators.rules import WEIGHTS


def _marked(judged_records: DataFrame, sample: str, order: str, width: int, weights: dict[str, float], bits: int) -> DataFrame:
    """Positions in the sample, typical records and those within ``width`` of a typical one that takes its context.

    Windows run over blocks of positions with a margin of ``width`` rows on both sides, not over whole samples.
    """
    weight = F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("severity"))
    x = judged_records.where(F.col(sample).isNotNull() & F.col("eventid").isNotNull())
    x = numbered(x, sample, order, "pos")
    # typical: not just info, and its words fit its template
    x = x.withColumn("typical", (F.col("severity") != "info") & F.col("params").isNotNull()).withColumn("weight", F.when(F.col("typical"), weight))
    x = x.withColumn("near_of", F.col("typical") & F.col("has_context"))
    block = F.shiftright(F.col("pos"), bits)
    spread = F.array_distinct(F.array(F.shiftright(F.col("pos") - width, bits), block, F.shiftright(F.col("pos") + width, bits)))
    x = x.withColumn("home", block).withColumn("block", F.explode(spread))
    w = Window.partitionBy(sample, "block").orderBy("pos").rowsBetween(-width, width)
    x = x.withColumn("near", F.max("near_of").over(w)).where("block = home")
    return x.select(sample, order, "pos", "eventid", "typical", "weight", "near")


def binary_features(judged_records: DataFrame, sample: str, order: str, width: int = 10, weights: dict[str, float] | None = None, bits: int = 16) -> DataFrame:
    """sample, eventid, value: the weight of the event's last typical record, else the weight of info if near one."""
    weights = weights or WEIGHTS
    x = _marked(judged_records, sample, order, width, weights, bits).where("typical OR near")
    own = F.max_by("weight", F.when(F.col("typical"), F.col("pos")))
    return x.groupBy(sample, "eventid").agg(F.coalesce(own, F.lit(float(weights["info"]))).alias("value"))


def count_features(judged_records: DataFrame, sample: str, order: str, width: int = 10, cover: str = "FULL", weights: dict[str, float] | None = None, bits: int = 16) -> DataFrame:
    """sample, eventid, n, value = n / denominator + weight; every record counts once.

    The denominator is the span that the windows sweep, from the first typical record to the last (FULL), or the number
    of records counted (PART).
    """
    weights = weights or WEIGHTS
    if cover not in ("FULL", "PART"):
        raise ValueError("cover is FULL or PART")
    m = _marked(judged_records, sample, order, width, weights, bits)
    own = F.max_by("weight", F.when(F.col("typical"), F.col("pos")))
    x = m.where("typical OR near").groupBy(sample, "eventid").agg(F.count(F.lit(1)).alias("n"), F.coalesce(own, F.lit(float(weights["info"]))).alias("weight"))
    low, high = F.min(F.when(F.col("typical"), F.col("pos"))), F.max(F.when(F.col("typical"), F.col("pos")))
    span = F.least(high + width, F.max("pos")) - F.greatest(low - width, F.lit(1)) + 1
    size = m.groupBy(sample).agg((span if cover == "FULL" else F.count(F.when(F.col("typical") | F.col("near"), 1))).alias("denominator"))
    return x.join(size, sample).select(sample, "eventid", "n", (F.col("n") / F.col("denominator") + F.col("weight")).alias("value"))
