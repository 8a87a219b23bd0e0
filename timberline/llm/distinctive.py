"""How distinctive a term is for a record, by divergence from randomness.

A term that occurs F times in N records is expected lambda = F / N times in each. Under the geometric collection
model (the limit of Bose-Einstein statistics) a frequency of tf carries

    -log2(1 / (1 + lambda)) - tf * log2(lambda / (1 + lambda))

bits. The frequency is length-normalised first, tfn = tf * log2(1 + c * mean length / length), and the bits are
multiplied by Laplace's after-effect gain 1 / (tfn + 1): what is learnt from one more occurrence of a term that
the record has already.

Scale: frequencies are combined before their shuffle; the written frequency table is read twice, once for the
statistics of the terms, once for the scores. A term in a third of all rows is one row per record by then, and the
statistics are one row per term, broadcast only if counted small, so a hot term isn't a hot key.

Outstanding terms are taken by score: a term with at least so many occurrences in a record, and in fewer than a share
of all records, has no lower score there than ``score_floor``, which follows from the record's length and the largest
collection frequency of a term that rare. Rows below it go; the exact counts are asked of those that stay.

Defined results: rows without a record, a term (null or blank) or a line number count nowhere; equal rows of one line
number count once; equal scores rank by term; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.plans.shared import join_counted, materialise
from timberline.plans.tables import event_records


def _score(tfn, rate):
    """Bits of the geometric model times Laplace's gain, of a normalised frequency and a rate in the collection."""
    return (F.log2(1 + rate) - tfn * F.log2(rate / (1 + rate))) / (tfn + 1)


def _rare(below_share: str):
    return F.col("df").cast("decimal(20,0)") < F.col("n_records").cast("decimal(20,0)") * F.lit(below_share).cast("decimal(10,6)")


def score_floor(tfn, top_rate: float):
    """The lowest score at a normalised frequency of ``tfn`` or more and a rate of ``top_rate`` or less.

    The score is a mean of log2(1 + rate) and log2((1 + rate) / rate), weighted 1 to tfn. Up to a rate of 1 the second
    is the larger, so the score grows with tfn; with the rate it falls until the rate is tfn. Beyond 1 it is no less than
    the second, which falls.
    """
    low = _score(tfn, F.least(tfn, F.lit(min(top_rate, 1.0))))
    return low if top_rate <= 1 else F.least(low, F.lit(math.log2((1 + top_rate) / top_rate)))


def _scored(records: DataFrame, record: str, term: str, c: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of record, term, tf, length, df, collection_tf, n_records, score; the statistics of terms; tfn of a frequency of 1."""
    tf = records.groupBy(F.col(record).alias("record"), F.col(term).alias("term")).agg(F.count(F.lit(1)).alias("tf"))
    # at most one row per term in a record's window, however many rows the record has
    tf = materialise(tf.withColumn("length", F.sum("tf").over(Window.partitionBy("record"))))
    totals = tf.agg(F.count_distinct("record").alias("n"), F.sum("tf").alias("total")).first()
    n, total = int(totals["n"] or 0), int(totals["total"] or 0)
    mean = total / n if n else 1.0
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("collection_tf"))
    stats = materialise(stats.withColumn("n_records", F.lit(n).cast("long")))
    x = join_counted(tf, stats, ["term"])
    once = F.log2(1 + F.lit(c * mean) / F.col("length"))
    return x.withColumn("score", _score(F.col("tf") * once, F.col("collection_tf") / F.lit(float(max(n, 1))))), stats, once


def term_scores(records: DataFrame, record: str, term: str, c: float = 1.0) -> DataFrame:
    """Scores of distinct (record, line, term) rows: record, term, tf, length, df, collection_tf, n_records, score, rank."""
    x, _, _ = _scored(records, record, term, c)
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("record").orderBy(F.desc("score"), "term")))
    return x.select(F.col("record").alias(record), F.col("term").alias(term), "tf", "length", "df", "collection_tf", "n_records", "score", "rank")


def high_scores(records: DataFrame, record: str, term: str, least_tf: int = 3, below_share: str = "0.03", c: float = 1.0) -> DataFrame:
    """Rows whose score is no lower than that of ``least_tf`` occurrences of any term in fewer than a share of all records."""
    x, stats, once = _scored(records, record, term, c)
    top = stats.where(_rare(below_share)).agg(F.max(F.col("collection_tf") / F.col("n_records"))).first()[0]
    if top is None:
        x = x.limit(0)
    else:
        # a hair lower, for the order in which floating numbers are added
        x = x.where(F.col("score") >= score_floor(least_tf * once, float(top)) * (1 - 1e-9))
    return x.select(F.col("record").alias(record), F.col("term").alias(term), "tf", "length", "df", "collection_tf", "n_records", "score")


def outstanding(records: DataFrame, record: str, term: str, least_tf: int = 3, below_share: str = "0.03", c: float = 1.0) -> DataFrame:
    """High scores that exact counts confirm: ``least_tf`` times in the record, in fewer than a share of all records."""
    return high_scores(records, record, term, least_tf, below_share, c).where((F.col("tf") >= least_tf) & _rare(below_share))


def session_scores(log: DataFrame, c: float = 1.0) -> DataFrame:
    """Scores of the eventids of each session."""
    return term_scores(event_records(log), "session_id", "eventid", c)


def outstanding_events(log: DataFrame) -> DataFrame:
    """The outstanding eventids of each session."""
    return outstanding(event_records(log), "session_id", "eventid")
