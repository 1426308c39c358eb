import pytest

from tidewater.errors import JobError
from tidewater.operators.merge import align_to_schema, upsert


def test_upsert_semantics(spark):
    tgt = spark.createDataFrame([(1, "a", "keep1"), (2, "b", "keep2"), (3, "c", "keep3")], "k int, v string, t string")
    src = spark.createDataFrame([(2, "B1", 1), (2, "B2", 2), (4, "D", 1), (None, "N", 1), (3, None, 1)],
                                "k int, v string, ord int")
    out = sorted((tuple(r) for r in upsert(tgt, src, ["k"], "ord").collect()), key=repr)
    assert out == sorted([(1, "a", "keep1"), (2, "B2", "keep2"), (3, None, "keep3"), (4, "D", None),
                          (None, "N", None)], key=repr)


def test_upsert_defaults_on_insert(spark):
    tgt = spark.createDataFrame([(1, "a", "x")], "k int, v string, t string")
    src = spark.createDataFrame([(2, "b")], "k int, v string")
    out = {r.k: r.t for r in upsert(tgt, src, ["k"], None, {"t": "dflt"}).collect()}
    assert out == {1: "x", 2: "dflt"}


def test_upsert_duplicate_keys_need_order(spark):
    tgt = spark.createDataFrame([(1, "a")], "k int, v string")
    src = spark.createDataFrame([(2, "b"), (2, "c")], "k int, v string")
    with pytest.raises(JobError):
        upsert(tgt, src, ["k"])


def test_idempotent(spark):
    tgt = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    src = spark.createDataFrame([(2, "z"), (3, "y")], "k int, v string")
    once = upsert(tgt, src, ["k"])
    twice = upsert(once, src, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_align(spark):
    from pyspark.sql import types as T
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    target = T.StructType([T.StructField("v", T.StringType()), T.StructField("k", T.IntegerType()),
                           T.StructField("z", T.StringType())])
    out = align_to_schema(df, target, {"z": "dz"})
    assert out.columns == ["v", "k", "z"] and out.collect()[0].z == "dz"
    with pytest.raises(JobError):
        align_to_schema(df.withColumn("extra", df.k), target)
