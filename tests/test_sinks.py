import glob
import os

import pytest
from pyspark.sql import functions as F

from tidewater.errors import JobError
from tidewater.session import local_path, scratch_path
from tidewater.sources.sinks import write_frame
from tidewater.spec import TargetSpec


def files_of(path):
    return sorted(glob.glob(os.path.join(local_path(path), "**", "*.parquet"), recursive=True))


def test_partition_scoped_upsert_keeps_untouched_files(spark):
    t = TargetSpec(kind="parquet", path=scratch_path(spark, "pup"), partition_by=("p",))
    base = spark.createDataFrame([(i, i % 3, f"v{i}") for i in range(30)], "k int, p int, v string")
    write_frame(spark, base, t, "FULL_LOAD")
    before = {f for f in files_of(t.path) if "p=0" in f or "p=2" in f}
    src = spark.createDataFrame([(1, 1, "new1"), (100, 1, "ins")], "k int, p int, v string")
    res = write_frame(spark, src, t, "UPSERT", upsert_keys=["k", "p"])
    after = set(files_of(t.path))
    assert before <= after  # partitions 0 and 2 were not rewritten
    got = {r.k: r.v for r in spark.read.parquet(t.path).collect()}
    assert got[1] == "new1" and got[100] == "ins" and got[4] == "v4" and len(got) == 31
    assert res.rows_written == 2


def test_full_load_replaces_via_staging(spark):
    t = TargetSpec(kind="parquet", path=scratch_path(spark, "fl"))
    write_frame(spark, spark.range(5).withColumnRenamed("id", "k"), t, "FULL_LOAD")
    # a plan that reads the target it replaces (overwrite-while-reading)
    cur = spark.read.parquet(t.path).withColumn("k", F.col("k") + 100)
    res = write_frame(spark, cur, t, "FULL_LOAD")
    assert sorted(r.k for r in spark.read.parquet(t.path).collect()) == [100, 101, 102, 103, 104]
    assert res.rows_written == 5
    assert not glob.glob(local_path(t.path) + ".__*")


def test_append_aligns_and_rejects_extra(spark):
    t = TargetSpec(kind="parquet", path=scratch_path(spark, "al"), defaults={"z": "dz"})
    write_frame(spark, spark.createDataFrame([(1, "a", "z1")], "k int, v string, z string"), t, "FULL_LOAD")
    write_frame(spark, spark.createDataFrame([("b", 2)], "v string, k int"), t, "APPEND")
    got = sorted(tuple(r) for r in spark.read.parquet(t.path).collect())
    assert got == [(1, "a", "z1"), (2, "b", "dz")]
    with pytest.raises(JobError):
        write_frame(spark, spark.createDataFrame([(3, "c", 1)], "k int, v string, extra int"), t, "APPEND")


def test_overwrite_replaces_schema(spark):
    t = TargetSpec(kind="parquet", path=scratch_path(spark, "ow"))
    write_frame(spark, spark.createDataFrame([(1, "a")], "k int, v string"), t, "FULL_LOAD")
    write_frame(spark, spark.createDataFrame([(2.5,)], "x double"), t, "OVERWRITE")
    assert spark.read.parquet(t.path).columns == ["x"]


def test_catalog_table_target(spark):
    name = "tw_test_tbl"
    spark.sql(f"drop table if exists {name}")
    t = TargetSpec(kind="table", table=name)
    write_frame(spark, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), t, "FULL_LOAD")
    write_frame(spark, spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), t, "UPSERT", upsert_keys=["k"])
    assert sorted(tuple(r) for r in spark.read.table(name).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    write_frame(spark, spark.createDataFrame([(9, "z")], "k int, v string"), t, "APPEND")
    assert spark.read.table(name).count() == 4
    spark.sql(f"drop table if exists {name}")


def test_table_full_load_reading_itself(spark):
    from tidewater.sources.sinks import reads_table
    name = "tw_self_tbl"
    spark.sql(f"drop table if exists {name}")
    t = TargetSpec(kind="table", table=name)
    write_frame(spark, spark.createDataFrame([(1,), (2,)], "k int"), t, "FULL_LOAD")
    own = spark.read.table(name).withColumn("k", F.col("k") * 10)
    other = spark.createDataFrame([(5,)], "k int")
    assert reads_table(own, name) and not reads_table(other, name)
    write_frame(spark, own, t, "FULL_LOAD")
    assert sorted(r.k for r in spark.read.table(name).collect()) == [10, 20]
    write_frame(spark, other, t, "TRUNCATE_INSERT")
    assert [r.k for r in spark.read.table(name).collect()] == [5]
    spark.sql(f"drop table if exists {name}")


def test_partition_scoped_upsert_two_levels(spark):
    t = TargetSpec(kind="parquet", path=scratch_path(spark, "pup2"), partition_by=("p", "q"))
    base = spark.createDataFrame([(i, i % 2, i % 3, f"v{i}") for i in range(24)], "k int, p int, q int, v string")
    write_frame(spark, base, t, "FULL_LOAD")
    untouched = {f for f in files_of(t.path) if "p=0" in f}
    src = spark.createDataFrame([(1, 1, 1, "new"), (99, 1, 2, "ins")], "k int, p int, q int, v string")
    write_frame(spark, src, t, "UPSERT", upsert_keys=["k", "p", "q"])
    assert untouched <= set(files_of(t.path))
    got = {r.k: r.v for r in spark.read.parquet(t.path).collect()}
    assert len(got) == 25 and got[1] == "new" and got[99] == "ins" and got[7] == "v7"


def test_recover_half_done_swaps(spark):
    import shutil
    from tidewater.session import local_path
    from tidewater.sources.sinks import recover_swaps
    # whole-folder swap interrupted after "target -> retired"
    t = TargetSpec(kind="parquet", path=scratch_path(spark, "rec"))
    write_frame(spark, spark.range(4).withColumnRenamed("id", "k"), t, "FULL_LOAD")
    os.rename(local_path(t.path), local_path(t.path) + ".__retired-abc")
    assert recover_swaps(spark, t.path) == [t.path]
    assert spark.read.parquet(t.path).count() == 4
    # partition swap interrupted: one partition moved aside, not replaced
    tp = TargetSpec(kind="parquet", path=scratch_path(spark, "recp"), partition_by=("p",))
    write_frame(spark, spark.createDataFrame([(i, i % 2) for i in range(6)], "k int, p int"), tp, "FULL_LOAD")
    root = local_path(tp.path)
    os.makedirs(root + ".__retired-xyz")
    shutil.move(os.path.join(root, "p=1"), os.path.join(root + ".__retired-xyz", "p=1"))
    got = write_frame(spark, spark.createDataFrame([(100, 0)], "k int, p int"), tp, "APPEND")
    assert got.rows_written == 1
    assert spark.read.parquet(tp.path).count() == 7


def test_empty_target_folder_counts_as_missing(spark):
    from tidewater.session import local_path
    t = TargetSpec(kind="parquet", path=scratch_path(spark, "emptydir"))
    os.makedirs(local_path(t.path))
    res = write_frame(spark, spark.range(3).withColumnRenamed("id", "k"), t, "APPEND")
    assert res.rows_written == 3 and spark.read.parquet(t.path).count() == 3
