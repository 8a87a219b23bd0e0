"""Reading the tables of a data folder, one parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet`` as a DataFrame."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def log_records(spark: SparkSession, folder: str) -> DataFrame:
    """The structured training log."""
    return table(spark, folder, "train_norm_structured")


def event_records(df: DataFrame, *more: str | Column) -> DataFrame:
    """Distinct (session_id, lineid, eventid, more...) of the records that have an event.

    Rows loaded again agree in these columns, so they fall together; the hash aggregation combines copies
    before the shuffle, so a heavily repeated record costs one row per input partition. Rows without a
    session or a line number have no place in a sequence and are left out. A blank eventid is no event.
    """
    cols = ["session_id", "lineid", "eventid", *more]
    return df.where(F.col("session_id").isNotNull() & F.col("lineid").isNotNull() & (F.trim("eventid") != "")).select(*cols).distinct()
