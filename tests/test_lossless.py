"""Loads that must not lose or change values: merges, targets, CSV, literals."""
import os

import pytest
from pyspark.sql import functions as F

from tidewater.errors import JobError
from tidewater.functions.rules import row_predicate
from tidewater.functions.transforms import fill_nulls
from tidewater.operators.merge import upsert
from tidewater.session import local_path, memory_bytes, scratch_path
from tidewater.sources.readers import read_csv
from tidewater.sources.sinks import recover_swaps, write_frame
from tidewater.spec import TargetSpec


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("limit", [0, None])
def test_upsert_is_strict_in_both_plans(spark, limit):
    target = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    fits = spark.createDataFrame([(1, 11), (3, 33), (None, 5)], "k long, v long")
    got = upsert(target, fits, ["k"], plan="auto", broadcast_limit=limit)
    assert rows(got) == rows(spark.createDataFrame([(1, 11), (2, 20), (3, 33), (None, 5)], "k int, v int")) and got.schema == target.schema
    for bad in ([(1, 3000000000)], [(5000000000, 1)], [(9, 3000000000)], [(None, 3000000000)]):
        with pytest.raises(Exception, match="out of range"):
            upsert(target, spark.createDataFrame(bad, "k long, v long"), ["k"], plan="auto", broadcast_limit=limit).collect()
    with pytest.raises(JobError):
        upsert(target, spark.createDataFrame([(1, "x")], "k int, v string"), ["k"], plan="auto", broadcast_limit=limit)


def test_partition_upsert_keeps_null_partition_and_text_partition(spark):
    t = TargetSpec(kind="parquet", path=scratch_path(spark, "np"), partition_by=("p",))
    write_frame(spark, spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "01", "c")], "k int, p string, v string"), t, "FULL_LOAD")
    write_frame(spark, spark.createDataFrame([(3, "01", "new"), (4, None, "d")], "k int, p string, v string"), t, "UPSERT", ("k", "p"))
    got = spark.read.schema("k int, v string, p string").parquet(t.path).select("k", "p", "v")
    assert rows(got) == rows(spark.createDataFrame([(1, None, "a"), (2, None, "b"), (4, None, "d"), (3, "01", "new")], "k int, p string, v string"))


def test_first_upsert_keeps_null_key_rows(spark):
    t = TargetSpec(kind="parquet", path=scratch_path(spark, "fu"))
    df = spark.createDataFrame([(None, 1, 1), (None, 2, 2), (1, 3, 1), (1, 4, 2)], "k int, v int, o int")
    assert write_frame(spark, df, t, "UPSERT", ("k",), "o").rows_written >= 3
    assert rows(spark.read.parquet(t.path).select("k", "v")) == rows(spark.createDataFrame([(None, 1), (None, 2), (1, 4)], "k int, v int"))


def test_append_of_another_kind_is_refused(spark):
    t = TargetSpec(kind="parquet", path=scratch_path(spark, "ap"))
    write_frame(spark, spark.createDataFrame([(1,)], "a int"), t, "APPEND")
    with pytest.raises(JobError) as e:
        write_frame(spark, spark.createDataFrame([("x",)], "a string"), t, "APPEND")
    assert e.value.code == "WRITE_FAILED" and spark.read.parquet(t.path).count() == 1
    write_frame(spark, spark.createDataFrame([(2,)], "a long"), t, "APPEND")
    assert rows(spark.read.parquet(t.path)) == [(1,), (2,)]


def test_a_finished_swap_does_not_revive_old_partitions(spark):
    t = TargetSpec(kind="parquet", path=scratch_path(spark, "rv"), partition_by=("p",))
    write_frame(spark, spark.createDataFrame([(1, 1), (2, 2)], "k int, p int"), t, "FULL_LOAD")
    old = spark.read.parquet(t.path).collect()
    assert len(old) == 2
    root = local_path(t.path)
    os.rename(root, root + ".__retiredall-dead")  # the driver died after the new rows were in place
    spark.createDataFrame([(3, 1)], "k int, p int").write.partitionBy("p").parquet(t.path)
    assert recover_swaps(spark, t.path) == [] and rows(spark.read.parquet(t.path)) == [(3, 1)]
    assert not os.path.exists(root + ".__retiredall-dead")


def write_text(spark, name, text):
    path = local_path(scratch_path(spark, name))
    os.makedirs(path)
    with open(os.path.join(path, "a.csv"), "w") as f:
        f.write(text)
    return path


def test_csv_keeps_quotes_breaks_and_big_integers(spark):
    path = write_text(spark, "q", 'a,b,c\n1,"say ""hi"", ok",12345678901234567890\n2,"two\nlines",1\n')
    assert rows(read_csv(spark, path)) == [(1, 'say "hi", ok', "12345678901234567890"), (2, "two\nlines", "1")]


@pytest.mark.parametrize("line", ["1,2,3", "1"])
def test_csv_refuses_ragged_rows(spark, line):
    path = write_text(spark, "r", f"a,b\nx,y\n{line}\n")
    with pytest.raises(Exception):
        read_csv(spark, path).collect()


def test_csv_target_keeps_its_text(spark):
    t = TargetSpec(kind="csv", path=write_text(spark, "ct", "k,v\n007,NA\n1,1.50\n"))
    write_frame(spark, spark.createDataFrame([("1", "new")], "k string, v string"), t, "UPSERT", ("k",))
    assert rows(spark.read.option("header", "true").csv(t.path)) == [("007", "NA"), ("1", "new")]


@pytest.mark.parametrize("params,kind,values,fails", [
    ({"min": 3000000000}, "int", [1, None, 2147483647], [True, False, True]),
    ({"max": 3000000000}, "int", [1, None], [False, False]),
    ({"min": 0.5, "max": 2.5}, "int", [0, 1, 2, 3], [True, False, False, True]),
    ({"max": "1.005"}, "decimal(10,2)", ["1.00", "1.01", None], [False, True, False]),
    ({"min": "1.005"}, "decimal(10,2)", ["1.00", "1.01"], [True, False]),
    ({"min": -1e30, "max": 1e30}, "long", [5], [False]),
])
def test_range_bounds_compare_exactly(spark, params, kind, values, fails):
    df = spark.createDataFrame([(i, None if v is None else str(v)) for i, v in enumerate(values)], "i int, s string").select("i", F.col("s").cast(kind).alias("c"))
    got = df.select("i", row_predicate("RANGE", F.col("c"), df.schema["c"].dataType, params).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == fails


def test_default_outside_the_type_is_kept(spark):
    df = spark.createDataFrame([(None,), (1,)], "c int")
    out, kind = fill_nulls(F.col("c"), df.schema["c"].dataType, 3000000000)
    assert rows(df.select(out)) == [(1,), (3000000000,)] and kind.simpleString() == "bigint"


def test_memory_counts_uncompressed_text(spark):
    df = spark.createDataFrame([("x" * 10000,)] * 1000, "t string")
    assert memory_bytes(df) >= 10_000_000


def test_streams_go_on_where_they_stopped(spark):
    from tidewater.plans.store import RunStore
    from tidewater.spec import JobSpec, SourceSpec
    from tidewater.streaming.scheduled import start_stream
    src = scratch_path(spark, "st_src")
    spark.range(10).write.parquet(src)
    store = RunStore(spark, scratch_path(spark, "st_store"))
    spec = JobSpec(name="again", source=SourceSpec(kind="parquet", path=src), target=TargetSpec(kind="parquet", path=scratch_path(spark, "st_tgt")),
                   load_strategy="APPEND")
    for want in (10, 10):
        start_stream(spark, spec, src, "id long", store=store).awaitTermination()
        assert spark.read.parquet(spec.target.path).count() == want
    spark.range(5).write.mode("append").parquet(src)
    start_stream(spark, spec, src, "id long", store=store).awaitTermination()
    assert spark.read.parquet(spec.target.path).count() == 15


def test_mark_does_not_depend_on_the_hosts_zone(spark, monkeypatch):
    import time
    from tidewater.plans.runner import run_job
    from tidewater.plans.store import RunStore
    from tidewater.spec import JobSpec, SourceSpec
    src = scratch_path(spark, "tz_src")
    spark.sql("select timestamp'2024-01-01 12:00:00 UTC' as t, 1 as k").write.parquet(src)
    store = RunStore(spark, scratch_path(spark, "tz_store"))
    spec = JobSpec(name="tz", source=SourceSpec(kind="parquet", path=src, checkpoint_col="t"),
                   target=TargetSpec(kind="parquet", path=scratch_path(spark, "tz_tgt")), load_strategy="INCREMENTAL")
    monkeypatch.setenv("TZ", "Europe/Istanbul")
    time.tzset()
    try:
        assert run_job(spark, spec, store).mark == "2024-01-01 12:00:00"
        spark.sql("select timestamp'2024-01-01 13:00:00 UTC' as t, 2 as k").write.mode("append").parquet(src)
        assert run_job(spark, spec, store).success_count == 1
    finally:
        monkeypatch.undo()
        time.tzset()


def test_violations_of_two_jobs_and_shapes(spark):
    from tidewater.plans.runner import run_job
    from tidewater.plans.store import RunStore
    from tidewater.spec import JobSpec, SourceSpec, ValidationRule
    store = RunStore(spark, scratch_path(spark, "vs"))
    runs = []
    for name, kind in (("one", "int"), ("two", "string"), ("one", "string")):
        src = scratch_path(spark, "vs_src")
        spark.createDataFrame([(None,), ("1",)], "a string").select(F.col("a").cast(kind)).write.parquet(src)
        spec = JobSpec(name=name, source=SourceSpec(kind="parquet", path=src), rules=(ValidationRule("NOT_NULL", "a"),),
                       target=TargetSpec(kind="parquet", path=scratch_path(spark, "vs_tgt")), load_strategy="OVERWRITE")
        runs.append(run_job(spark, spec, store).run_id)
    assert store.violations().count() == 3 and store.violations("two").count() == 1
    one = store.violations_of(runs[0])
    assert one.count() == 1 and "PartitionFilters: [isnotnull(run_date" in one._jdf.queryExecution().toString()


def test_row_index_stop_and_failure_records(spark):
    from tidewater.plans.runner import run_job
    from tidewater.plans.store import RunStore
    from tidewater.spec import JobSpec, SourceSpec, ValidationRule
    src = scratch_path(spark, "ri_src")
    spark.range(50).write.parquet(src)
    store = RunStore(spark, scratch_path(spark, "ri_store"))
    def spec(action):
        return JobSpec(name="ri", source=SourceSpec(kind="parquet", path=src), rules=(ValidationRule("RANGE", "id", {"max": 39}, action),), row_index=True,
                       target=TargetSpec(kind="parquet", path=scratch_path(spark, "ri_tgt")), load_strategy="OVERWRITE")
    ok = run_job(spark, spec("REJECT"), store)
    assert (ok.source_count, ok.success_count, ok.rejected_count) == (50, 40, 10)
    stopped = run_job(spark, spec("STOP"), store, raise_on_error=False)
    assert stopped.status == "FAILED" and stopped.rejected_count == store.violations_of(stopped.run_id).count() == 10
    stages = [r.stage for r in store.logs().where(F.col("job_run_id") == ok.run_id).orderBy("seq").collect()]
    assert "TARGET_CONNECTED" in stages
    bad = run_job(spark, JobSpec(name="bad", source=SourceSpec(kind="sql", query="select raise_error('boom') as x"),
                                 target=TargetSpec(kind="parquet", path=scratch_path(spark, "bad")), load_strategy="APPEND"), store, raise_on_error=False)
    assert "boom" in store.runs().where(F.col("id") == bad.run_id).first().error_detail


def test_describe_table_keeps_declared_lengths(spark):
    from tidewater.sources.readers import describe_table
    spark.sql("drop table if exists described")
    spark.sql("create table described (a varchar(20), b string, c char(3)) using parquet")
    try:
        got = {r.column_name if "column_name" in r.asDict() else r[0]: r.max_length for r in describe_table(spark, "described").collect()}
    finally:
        spark.sql("drop table described")
    assert got == {"a": 20, "b": None, "c": 3}


def test_range_of_valid_rows_reaches_the_scan(spark):
    from tidewater.operators.validate import validate
    from tidewater.spec import ValidationRule
    path = scratch_path(spark, "push")
    spark.range(100).selectExpr("id", "case when id % 10 = 0 then null else id end as x").write.parquet(path)
    valid = validate(spark.read.parquet(path), (ValidationRule("RANGE", "x", {"min": 5, "max": 50}),), persist=False).valid()
    plan = valid._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,5)" in plan and "LessThanOrEqual(x,50)" in plan
    assert valid.count() == sum(i % 10 == 0 or 5 <= i <= 50 for i in range(100))
