"""Fixed-length event sequences inside sessions, and what comes next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators.islands import numbered
from timberline.plans.shared import with_vectors


def event_sequences(records: DataFrame, session: str, order: str, width: int, label: str | None = None, event: str = "idx", bits: int = 16) -> DataFrame:
    """session, order (of the target), pos, event_seq (width events before it), target, label.

    The label is the greatest of the records of sequence and target. Sessions of at most ``width`` records give none.
    Windows run over blocks of positions; a block also gets the ``width`` records before it.
    """
    x = records.where(F.col(session).isNotNull()).select(session, F.col(order), F.col(event).alias("_event"), (F.coalesce(F.col(label), F.lit(0)) if label else F.lit(0)).alias("_label"))
    x = numbered(x, session, order, "pos")
    home = F.shiftright(F.col("pos"), bits)
    x = x.withColumn("home", home).withColumn("block", F.explode(F.array_distinct(F.array(home, F.shiftright(F.col("pos") + width, bits)))))
    w = Window.partitionBy(session, "block").orderBy("pos")
    x = x.withColumns({"event_seq": F.collect_list("_event").over(w.rowsBetween(-width, -1)), "label": F.max("_label").over(w.rowsBetween(-width, 0))})
    x = x.where((F.col("block") == F.col("home")) & (F.col("pos") > width))
    return x.select(session, order, "pos", "event_seq", F.col("_event").alias("target"), "label")


def next_event_counts(sequences: DataFrame) -> DataFrame:
    """event_seq, target, n: how often each event followed each sequence."""
    return sequences.groupBy("event_seq", "target").agg(F.count(F.lit(1)).alias("n"))


def ranked(counts: DataFrame) -> DataFrame:
    """Adds rank of each target after its sequence, most frequent first. At most a vocabulary's worth of rows in each."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("event_seq").orderBy(F.desc("n"), "target")))


def rank_anomalies(sequences: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """Adds rank (null if never seen) and anomalous: the target isn't among the k most likely."""
    x = sequences.join(ranks.select("event_seq", "target", "rank"), ["event_seq", "target"], "left")
    return x.withColumn("anomalous", F.coalesce((F.col("rank") > k).cast("int"), F.lit(1)))


def parameter_anomalies(anomalies: DataFrame, judged: DataFrame, order: str = "lineid") -> DataFrame:
    """Records that follow their sequence are still anomalous if their rule says so: adds severity, changes anomalous.

    judged: order and severity, one row per record (operators.rules); records that it lacks are not judged.
    """
    x = anomalies.join(judged.select(order, "severity"), order, "left").withColumn("severity", F.coalesce("severity", F.lit("info")))
    return x.withColumn("anomalous", F.greatest("anomalous", (F.col("severity") != "info").cast("int")))


def one_hot(sequences: DataFrame, size: int) -> DataFrame:
    """Adds features: the events of the sequence one-hot, as one sparse vector of width times size."""
    width = sequences.select(F.max(F.size("event_seq"))).first()[0] or 0
    return with_vectors(sequences, width * size, F.transform("event_seq", lambda e, i: i * size + e), F.transform("event_seq", lambda e: F.lit(1.0)))


def scalar(sequences: DataFrame) -> DataFrame:
    """Adds features: the event numbers of the sequence as they are."""
    from pyspark.ml.functions import array_to_vector

    return sequences.withColumn("features", array_to_vector(F.transform("event_seq", lambda e: e.cast("double"))))
