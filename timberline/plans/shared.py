"""Where intermediate tables live, and how small sides are joined.

A cluster names a folder that all its executors share in ``spark.checkpoint.dir``. Tables written there
survive the loss of executors, cut the lineage, and are compressed. Only where the setting is absent and all runs
on one machine (tests, a laptop) is a folder chosen here; a cluster without the setting is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A side is broadcast only if it was counted and has at most so many rows (of a few short columns).
BROADCAST_ROWS = 200_000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode without such a setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="timberline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and return the written table, read as ``schema`` if given: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(schema or df.schema).parquet(path)


def with_vectors(df: DataFrame, size: int, indices: Column, values: Column, name: str = "features") -> DataFrame:
    """Adds a column of sparse vectors of ``size``, written and read again as such: MLlib reads its rows many times.

    ``indices`` (ascending) and ``values`` are arrays. Nothing leaves the JVM, and no row becomes dense.
    """
    from pyspark.ml.linalg import VectorUDT

    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), indices.cast("array<int>").alias("indices"), values.cast("array<double>").alias("values"))
    x = df.withColumn(name, parts)
    return materialise(x, StructType([StructField(f.name, VectorUDT()) if f.name == name else f for f in x.schema]))


def _drop_all() -> None:
    for spark, path in _written:
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass
    _written.clear()


atexit.register(_drop_all)


def release(df: DataFrame) -> None:
    """Delete the files of a table written by :func:`materialise` that nothing will read any more."""
    spark = df.sparkSession
    names = set(df.inputFiles())
    for item in list(_written):
        if any(item[1].rsplit("/", 1)[1] in n for n in names):
            p = spark._jvm.org.apache.hadoop.fs.Path(item[1])
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            _written.remove(item)


def join_counted(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with a side whose row count is checked: broadcast up to BROADCAST_ROWS, a shuffled join beyond.

    ``small`` should be cheap to count (a materialised or fixed table). ``rows`` is its count where known.
    """
    n = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, how)


def block_of(order: Column, bits: int = 16) -> Column:
    """Blocks of 2**bits successive order numbers: a bounded unit of work inside groups of any size."""
    return F.shiftright(order, bits)


def ship(spark: SparkSession) -> SparkSession:
    """Let functions of this package travel to the Python workers by value: clusters needn't have it installed."""
    from pyspark import cloudpickle

    import timberline

    cloudpickle.register_pickle_by_value(timberline)
    return spark
