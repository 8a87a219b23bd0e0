"""Writing results."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, order: list[str], column: str = "value") -> None:
    """One text line per row, range-partitioned by the order columns."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(column).write.mode("overwrite").text(path)


def write_library(library: DataFrame, folder: str, version: str | None = None) -> str:
    """A new version of a template library; older ones stay as they are. Returns its path."""
    version = version or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    path = f"{folder}/version={version}"
    library.write.parquet(path)
    return path


def latest_library(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of a template library, also if it is empty: versions are told by their folders."""
    x = spark.read.parquet(folder)
    newest = max(f.rsplit("/version=", 1)[1].split("/", 1)[0] for f in x.inputFiles())
    return spark.read.schema(x.drop("version").schema).parquet(f"{folder}/version={newest}")


def write_structured(df: DataFrame, path: str) -> None:
    """A structured log, for reading again by file."""
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as CSV with a header."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def as_text(df: DataFrame, limit: int = 100) -> str:
    """A report's first rows as text for people."""
    rows = df.limit(limit).collect()
    return "\n".join("  ".join("" if v is None else str(v) for v in r) for r in rows)


def write_matrix(vectors: DataFrame, vocabulary: DataFrame, path: str, label: str = "label") -> None:
    """A count matrix as CSV for people: one column per event of the vocabulary, in its order, and the label last.

    ``vectors`` has features and label. Events are hundreds or thousands, so a row is one line of text.
    """
    from pyspark.ml.functions import vector_to_array

    names = [r["eventid"] for r in vocabulary.orderBy("idx").collect()]
    seen: dict[str, int] = {}
    columns = []
    for k, n in enumerate(names):
        # free places share one name: they are numbered
        seen[n] = seen.get(n, 0) + 1
        columns.append(F.col("_v")[k].alias(n if seen[n] == 1 else f"{n}_{seen[n]}"))
    x = vectors.withColumn("_v", vector_to_array("features")).select(*columns, F.col(label))
    x.write.mode("overwrite").option("header", True).csv(path)


def write_files(lines: DataFrame, folder: str, key: str = "file_id", order: str = "line_no", column: str = "value") -> None:
    """A text file per value of ``key``, each in a folder of its own, lines in order."""
    x = lines.select(key, order, F.coalesce(column, F.lit("")).alias(column)).repartition(key).sortWithinPartitions(key, order)
    x.select(key, column).write.mode("overwrite").partitionBy(key).text(folder)
