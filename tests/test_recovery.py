"""Interrupted and repeated loads, merges by files, and CSV rows that do not fit."""
import os

import pytest
from pyspark.sql import functions as F

from tidewater.errors import JobError
from tidewater.plans.runner import run_job
from tidewater.plans.store import RunStore
from tidewater.session import local_path, scratch_path
from tidewater.sources import publish
from tidewater.sources.readers import BAD_ROW, read_csv, read_source
from tidewater.sources.sinks import read_target, write_frame
from tidewater.spec import JobSpec, SourceSpec, TargetSpec
from tidewater.spec import ValidationRule as V


def _stat(path):
    root = local_path(path)
    return {f: os.stat(os.path.join(root, f)).st_mtime_ns for f in os.listdir(root) if f.endswith(".parquet")}


def _kv(spark, rows):
    return spark.createDataFrame(rows, "k int, v string")


def test_untouched_files_keep_name_and_time(spark):
    t = TargetSpec(kind="parquet", path=scratch_path(spark, "cow"))
    write_frame(spark, spark.range(1000).selectExpr("cast(id as int) as k", "'old' as v").repartitionByRange(8, "k"), t, "FULL_LOAD")
    before = _stat(t.path)
    res = write_frame(spark, _kv(spark, [(3, "new"), (5000, "ins"), (None, "null key")]), t, "UPSERT", ("k",))
    after = _stat(t.path)
    assert res.files_replaced == 1 and res.rows_written == 3
    same = {f for f in before if after.get(f) == before[f]}
    assert len(same) == len(before) - 1
    got = {(r.k, r.v) for r in spark.read.parquet(t.path).collect()}
    assert {(3, "new"), (5000, "ins"), (None, "null key"), (4, "old")} <= got and len(got) == 1002
    # keys outside every file: nothing is rewritten
    res = write_frame(spark, _kv(spark, [(9000, "x")]), t, "UPSERT", ("k",))
    assert res.files_replaced == 0 and set(after.items()) <= set(_stat(t.path).items())
    assert spark.read.parquet(t.path).count() == 1003


def test_only_touched_files_are_read_in_full(spark):
    """The scan that looks for touched files has the key columns only, and the key's range."""
    from tidewater.operators.merge import prepare_source
    from tidewater.sources import sinks
    t = TargetSpec(kind="parquet", path=scratch_path(spark, "cowplan"))
    write_frame(spark, spark.range(100).selectExpr("cast(id as int) as k", "'old' as v"), t, "FULL_LOAD")
    current = read_target(spark, t)
    seen = []
    real = type(current).collect

    def spy(self):
        seen.append(self._jdf.queryExecution().executedPlan().toString())
        return real(self)
    type(current).collect = spy
    try:
        sinks.touched_files(spark, current, t, prepare_source(current.schema, _kv(spark, [(3, "x")]), ["k"], None), ["k"])
    finally:
        type(current).collect = real
    scan = next(p for p in seen if "file_path" in p)
    assert "ReadSchema: struct<k:int>" in scan and "GreaterThanOrEqual(k,3)" in scan


def test_merge_by_files_in_partitions_with_odd_names(spark):
    t = TargetSpec(kind="parquet", path=scratch_path(spark, "cow odd"), partition_by=("p",))
    base = spark.createDataFrame([(i, f"a b={i % 3}%/:x", f"v{i}") for i in range(30)], "k int, p string, v string")
    write_frame(spark, base, t, "FULL_LOAD")
    # the partition column is no key: rows may move between partitions
    write_frame(spark, spark.createDataFrame([(4, "moved", "new"), (77, "a b=1%/:x", "ins")], "k int, p string, v string"), t, "UPSERT", ("k",))
    got = {r.k: (r.p, r.v) for r in read_target(spark, t, base.schema).collect()}
    assert len(got) == 31 and got[4] == ("moved", "new") and got[77] == ("a b=1%/:x", "ins") and got[7] == ("a b=1%/:x", "v7")


@pytest.mark.parametrize("partitioned", [False, True])
@pytest.mark.parametrize("strategy", ["FULL_LOAD", "APPEND", "UPSERT"])
@pytest.mark.parametrize("step", publish.STEPS)
def test_lost_at_any_step(spark, strategy, step, partitioned):
    t = TargetSpec(kind="parquet", path=scratch_path(spark, "lost"), partition_by=("p",) if partitioned else ())
    write_frame(spark, spark.createDataFrame([(i, i % 2, "old") for i in range(6)], "k int, p int, v string"), t, "FULL_LOAD")
    change = spark.createDataFrame([(0, 0, "new"), (100, 0, "new")], "k int, p int, v string")
    with publish.lost_at(step), pytest.raises(publish.DriverLost):
        write_frame(spark, change, t, strategy, ("k", "p"))
    old = {(i, i % 2, "old") for i in range(6)}
    new = {(0, 0, "new"), (100, 0, "new")}
    full = {"FULL_LOAD": new, "APPEND": old | new, "UPSERT": old - {(0, 0, "old")} | new}[strategy]
    want = old if step == "staged" else full
    rows = lambda df: sorted((r.k, r.p, r.v) for r in df.collect())
    assert rows(read_target(spark, t)) == sorted(want)
    assert rows(read_source(spark, SourceSpec(kind="parquet", path=t.path))) == sorted(want)
    publish.settle(spark, t.path)
    assert rows(spark.read.parquet(t.path)) == sorted(want)
    assert publish.settle(spark, t.path) == []


def test_receipt_goes_with_a_replacement(spark):
    """Rows that an incremental run loaded and a full load has replaced are read again."""
    src = scratch_path(spark, "rcpt_src")
    spark.range(10).selectExpr("id", "id as ts").write.parquet(src)
    store = RunStore(spark, scratch_path(spark, "rcpt_store"))
    spec = JobSpec(name="rcpt", source=SourceSpec(kind="parquet", path=src, checkpoint_col="ts"), target=TargetSpec(kind="parquet", path=scratch_path(spark, "rcpt")), load_strategy="INCREMENTAL")

    class Lost(RunStore):
        def append_run(self, record, logs):
            raise publish.DriverLost("record")
    with pytest.raises(publish.DriverLost):
        run_job(spark, spec, Lost(spark, store.base))
    assert publish.receipt_of(spark, spec.target.path, "rcpt")["mark"] == "9"
    write_frame(spark, spark.range(0).selectExpr("id", "id as ts"), spec.target, "FULL_LOAD")
    assert publish.receipt_of(spark, spec.target.path, "rcpt") is None
    assert run_job(spark, spec, store).success_count == 10
    assert run_job(spark, spec, store).success_count == 0
    # the other way: what is loaded is not loaded again, and the mark is recorded even if nothing is new
    src2 = scratch_path(spark, "rcpt_src2")
    spark.range(5).selectExpr("id", "id as ts").write.parquet(src2)
    spec2 = JobSpec(name="rcpt2", source=SourceSpec(kind="parquet", path=src2, checkpoint_col="ts"), target=TargetSpec(kind="parquet", path=scratch_path(spark, "rcpt2")), load_strategy="INCREMENTAL")
    with pytest.raises(publish.DriverLost):
        run_job(spark, spec2, Lost(spark, store.base))
    res = run_job(spark, spec2, store)
    assert res.status == "SUCCESS" and res.success_count == 0 and store.mark_of("rcpt2")["checkpoint_value"] == "4"
    assert spark.read.parquet(spec2.target.path).count() == 5


def _text(spark, lines):
    path = scratch_path(spark, "csvtext")
    os.makedirs(local_path(path))
    with open(os.path.join(local_path(path), "a.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_csv_values_that_do_not_fit(spark):
    path = _text(spark, ["a,b", "1,x", "99999999999,y", "abc,z", "NULL,w"])
    with pytest.raises(Exception, match="CSV value does not fit a int"):
        read_csv(spark, path, schema="a int, b string").collect()
    rows = read_csv(spark, path, schema="a int, b string", bad_rows="quarantine").collect()
    good = sorted((r.a, r.b) for r in rows if r[BAD_ROW] is None and r.a is not None)
    bad = sorted((r[BAD_ROW].line, r[BAD_ROW].column, r[BAD_ROW].rule) for r in rows if r[BAD_ROW] is not None)
    assert good == [(1, "x")] and bad == [("99999999999,y", "a", "CSV_TYPE"), ("abc,z", "a", "CSV_TYPE")]
    assert sum(r.a is None and r[BAD_ROW] is None for r in rows) == 1  # a null token is no misfit


def test_csv_rows_of_another_width(spark):
    path = _text(spark, ["a,b", "1,x", "2,y,EXTRA", "3", '4,"two', 'lines"'])
    with pytest.raises(Exception):
        read_csv(spark, path).collect()
    rows = read_csv(spark, path, bad_rows="quarantine").collect()
    assert sorted((r.a, r.b) for r in rows if r[BAD_ROW] is None) == [(1, "x"), (4, "two\nlines")]
    assert {(r[BAD_ROW].line, r[BAD_ROW].rule) for r in rows if r[BAD_ROW] is not None} == {("2,y,EXTRA", "CSV_FORMAT"), ("3", "CSV_FORMAT")}
    with pytest.raises(JobError):
        read_csv(spark, path, bad_rows="drop")


def test_strict_csv_stream_stops(spark):
    """Without quarantine a stream fails on rows that do not parse; nothing of the batch is loaded."""
    from tidewater.streaming.scheduled import start_stream
    path = _text(spark, ["k,v", "1,a", "2,y,EXTRA"])
    spec = JobSpec(name="strictcsv", source=SourceSpec(kind="csv", path=path), target=TargetSpec(kind="parquet", path=scratch_path(spark, "strictcsv")), load_strategy="APPEND")
    q = start_stream(spark, spec, path, "k int, v string", fmt="csv", store=RunStore(spark, scratch_path(spark, "strictcsv_store")))
    with pytest.raises(Exception):
        q.awaitTermination()
    assert read_target(spark, spec.target) is None


def test_pinned_only_where_the_source_may_change(spark, sf_small):
    from tidewater.plans.runner import repeats
    spark.read.parquet(f"{sf_small}/nation.parquet").createOrReplaceTempView("pin_nation")
    job = lambda s: JobSpec(name="pin", source=s, target=TargetSpec(kind="parquet", path="x"))
    check = lambda q: repeats(job(SourceSpec(kind="sql", query=q)), spark.sql(q), False, False)
    assert check("select * from pin_nation where n_regionkey > 1")
    assert not check("select * from pin_nation limit 3") and not check("select rand() from pin_nation")
    parquet = job(SourceSpec(kind="parquet", path=f"{sf_small}/nation.parquet"))
    assert repeats(parquet, spark.table("pin_nation"), False, False)
    assert not repeats(parquet, spark.table("pin_nation"), True, False) and not repeats(parquet, spark.table("pin_nation"), False, True)
    assert not repeats(job(SourceSpec(kind="jdbc", table="t")), spark.table("pin_nation"), False, False)


def test_keys_of_a_stream_are_written_again_for_a_repeated_batch(spark):
    from tidewater.streaming.scheduled import UniqueAcross, batch_runner
    store = RunStore(spark, scratch_path(spark, "uniq_store"))
    spec = JobSpec(name="uniq", source=SourceSpec(kind="parquet", path="unused"), target=TargetSpec(kind="parquet", path=scratch_path(spark, "uniq")), load_strategy="APPEND", rules=(V("UNIQUE", "k"),))

    class Lost(RunStore):
        def append_run(self, record, logs):
            raise publish.DriverLost("record")
    first, second = _kv(spark, [(1, "a"), (2, "b"), (None, "n")]), _kv(spark, [(2, "again"), (3, "c"), (None, "n2")])
    with pytest.raises(publish.DriverLost):  # committed, not recorded
        batch_runner(spec, Lost(spark, store.base), "u", unique=UniqueAcross("k"))(first, 0)
    run = batch_runner(spec, store, "u", unique=UniqueAcross("k"))
    run(first, 0)
    run(second, 1)
    assert sorted((r.k is None, r.k or 0, r.v) for r in spark.read.parquet(spec.target.path).collect()) == [(False, 1, "a"), (False, 2, "b"), (False, 3, "c"), (True, 0, "n")]
    assert store.runs().where(F.col("status") == "SUCCESS").count() == 2
