"""What must not be dropped or go astray: ids of large libraries, addresses of odd forms, the shared folder."""

import pytest

from timberline.functions.text import mask
from timberline.logtypes import CM
from timberline.operators import vocabulary
from timberline.plans import shared


def test_vocabulary_keeps_all_ids_of_a_large_library(spark):
    library = spark.createDataFrame([(f"e{i:03d}",) for i in range(40)], "eventid string")
    got = {r["eventid"]: r["idx"] for r in vocabulary.build(library, 8).collect()}
    assert len(got) == 41 and sorted(got.values()) == list(range(41)) and got["ffffffff"] == 40


def test_insert_tells_when_there_is_no_room(spark):
    v = vocabulary.build(spark.createDataFrame([("a",), ("b",)], "eventid string"), 4)
    new = lambda *ids: spark.createDataFrame([(i,) for i in ids], "eventid string")
    assert {r["eventid"] for r in vocabulary.insert(v, new("a", "c")).collect()} == {"a", "b", "c", "ffffffff"}
    with pytest.raises(ValueError, match="2 new ids, but 1 free"):
        vocabulary.insert(v, new("c", "d"))


def test_addresses_of_odd_forms(spark):
    df = spark.createDataFrame([(t,) for t in (" a::", " 1::2:3:4:5:6", " a::1:2:3:4:5", " to fe80::1/64 up", " 1:2:3:4:5:6:7:8 x")], "t string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(mask(F.col("t"), [m for m in CM.masks if "::" in m[0]])).collect()]
    assert got == [" <*>", " <*>:6", " <*>:5", " to <*> up", " <*> x"]


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

        def set(self, key, value):
            self.values[key] = value

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.shared_dir(Session(spark_master=master))
    assert shared.shared_dir(Session(spark_master="yarn", spark_checkpoint_dir="hdfs:///x/")) == "hdfs:///x"
    assert shared.shared_dir(Session(spark_master="local[4]")).startswith("file:")
