import pytest
from pyspark.sql import functions as F

from tidewater.errors import JobError, ValidationStop
from tidewater.operators import history
from tidewater.plans.runner import run_job
from tidewater.plans.store import RunStore, utcnow
from tidewater.session import scratch_path
from tidewater.spec import ColumnMapping as M
from tidewater.spec import JobSpec, SourceSpec, TargetSpec
from tidewater.spec import TransformRule as R
from tidewater.spec import ValidationRule as V
from tidewater.spec import job_from_dict


@pytest.fixture()
def store(spark):
    return RunStore(spark, scratch_path(spark, "store"))


def orders_spec(spark, sf, **kw):
    base = dict(name="o", source=SourceSpec(kind="parquet", path=f"{sf}/orders.parquet"),
                target=TargetSpec(kind="parquet", path=scratch_path(spark, "tgt")))
    base.update(kw)
    return JobSpec(**base)


def test_full_run_counts(spark, sf_small, store):
    spec = orders_spec(spark, sf_small, rules=(V("RANGE", "o_totalprice", {"max": 300000}),
                                               V("REGEX", "prio", {"pattern": "^1"}, "WARN")),
                       mappings=(M("prio", "o_orderpriority", 0, transform_rules=(R("UPPER"),)),))
    res = run_job(spark, spec, store)
    src = spark.read.parquet(f"{sf_small}/orders.parquet")
    over = src.where("o_totalprice > 300000").count()
    not1 = src.where("not o_orderpriority like '1%'").count()
    assert res.status == "SUCCESS" and res.source_count == src.count()
    assert res.success_count == src.count() - over
    assert res.rejected_count == over + not1 and res.rejected_rows == over
    assert spark.read.parquet(spec.target.path).count() == res.success_count
    runs = store.runs().collect()
    assert runs[0].status == "SUCCESS" and runs[0].rejected_count == over + not1
    assert store.violations().count() == over + not1
    stages = [r.stage for r in history.run_log(store.logs(), res.run_id, order_cols=("seq",)).collect()]
    assert stages[0] == "METADATA" and stages[-1] == "JOB_SUCCESS" and "VALIDATION_WARN" in stages


def test_incremental_slices_equal_full_load(spark, sf_small, store):
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    src_dir = scratch_path(spark, "inc_src")
    spec = JobSpec(name="inc", source=SourceSpec(kind="parquet", path=src_dir, checkpoint_col="ts"),
                   target=TargetSpec(kind="parquet", path=scratch_path(spark, "inc_tgt")), load_strategy="INCREMENTAL",
                   mappings=(M("when", "ts", 0),))
    for lo, hi in (("2000-01-01", "2024-01-08"), ("2024-01-08", "2024-01-21"), ("2024-01-21", "2100-01-01")):
        ev.where((F.col("ts") >= lo) & (F.col("ts") < hi)).write.mode("append").parquet(src_dir)
        run_job(spark, spec, store)
    # a run with nothing new is a NO_DATA success
    res = run_job(spark, spec, store)
    assert res.status == "SUCCESS" and res.source_count == 0
    got = spark.read.parquet(spec.target.path)
    assert got.count() == ev.count() and got.select("event_id").distinct().count() == ev.count()
    mark = store.mark_of("inc")["checkpoint_value"]
    assert mark == str(ev.agg(F.max("ts")).collect()[0][0])


def test_stop_leaves_target_untouched(spark, sf_small, store):
    spec = orders_spec(spark, sf_small, rules=(V("RANGE", "o_totalprice", {"max": 1000}, "STOP"),))
    with pytest.raises(ValidationStop):
        run_job(spark, spec, store)
    from tidewater.sources.sinks import path_exists
    assert not path_exists(spark, spec.target.path)
    assert store.runs().collect()[0].status == "FAILED"


def test_test_run_writes_nothing(spark, sf_small, store):
    spec = orders_spec(spark, sf_small)
    res = run_job(spark, spec, store, run_type="TEST", test_limit=7)
    from tidewater.sources.sinks import path_exists
    assert res.source_count == 7 and res.success_count == 7 and not path_exists(spark, spec.target.path)


def test_drift_stop(spark, sf_small, store):
    spec = orders_spec(spark, sf_small, expected_schema="o_orderkey bigint, o_comment string",
                       schema_drift_action="STOP")
    res = run_job(spark, spec, store, raise_on_error=False)
    assert res.status == "FAILED" and res.error_code == "SCHEMA_DRIFT"


def test_missing_target_without_create(spark, sf_small, store):
    spec = orders_spec(spark, sf_small, target=TargetSpec(kind="parquet", path=scratch_path(spark, "nope"),
                                                          create_if_not_exists=False))
    with pytest.raises(JobError) as e:
        run_job(spark, spec, store)
    assert e.value.code == "TABLE_NOT_FOUND"


def test_job_from_dict_checks():
    d = {"name": "x", "source_config": {"kind": "parquet", "path": "p"}, "target_config": {"kind": "parquet", "path": "q"},
         "load_strategy": "UPSERT", "column_mappings": [{"source_column": "a", "target_column": "b",
                                                          "transform_rules": [{"transform_type": "TRIM", "apply_order": 0}]}],
         "validation_rules": [{"rule_type": "NOT_NULL", "mapping": {"target_column": "b"}}]}
    with pytest.raises(JobError):
        job_from_dict(d)
    d["upsert_keys"] = ["b"]
    spec = job_from_dict(d)
    assert spec.rules[0].column == "b" and spec.mappings[0].transform_rules[0].transform_type == "TRIM"


def test_run_with_population_rules(spark, sf_small, store):
    spec = orders_spec(spark, sf_small, rules=(V("UNIQUE", "o_custkey", {}, "WARN"), V("DUPLICATE_CHECK"),
                                               V("RANGE", "o_totalprice", {"max": 300000})))
    res = run_job(spark, spec, store)
    src = spark.read.parquet(f"{sf_small}/orders.parquet")
    dup_cust = src.groupBy("o_custkey").count().where("count > 1").agg(F.sum("count")).collect()[0][0] or 0
    over = src.where("o_totalprice > 300000").count()
    assert res.per_rule[0]["failures"] == dup_cust and res.per_rule[1]["failures"] == 0
    assert res.success_count == src.count() - over
    assert res.rejected_count == dup_cust + over


def test_violations_json_export_keeps_microseconds(spark, sf_small, store):
    from tidewater.plans.store import violations_as_json
    spec = orders_spec(spark, sf_small, rules=(V("RANGE", "o_totalprice", {"max": 300000}),), row_key=("o_orderkey",))
    run_job(spark, spec, store)
    js = violations_as_json(store.violations()).select("source_data").first()[0]
    assert '"o_orderdate":"' in js and ".000000" in js


def test_rule_that_cannot_fail_does_not_hang(spark, sf_small, store):
    """NOT_NULL on a column COALESCE made non-nullable folds to false."""
    spec = orders_spec(spark, sf_small,
                       mappings=(M("o_orderstatus", "o_orderstatus", 0, transform_rules=(R("COALESCE", {"default": "?"}),)),),
                       rules=(V("NOT_NULL", "o_orderstatus"),))
    res = run_job(spark, spec, store)
    n = spark.read.parquet(f"{sf_small}/orders.parquet").count()
    assert res.status == "SUCCESS" and res.rejected_count == 0 and res.success_count == n and res.source_count == n


def test_rule_that_rejects_everything_does_not_hang(spark, sf_small, store):
    """NOT_NULL on a missing (all-NULL) column rejects every row: the valid
    frame is provably empty and the FULL_LOAD writes zero rows."""
    spec = orders_spec(spark, sf_small, mappings=(M("ghost", "no_such_column", 0),),
                       rules=(V("NOT_NULL", "ghost"),))
    res = run_job(spark, spec, store)
    n = spark.read.parquet(f"{sf_small}/orders.parquet").count()
    assert res.status == "SUCCESS" and res.success_count == 0 and res.rejected_rows == n
    assert spark.read.parquet(spec.target.path).count() == 0


def test_upsert_with_all_rows_rejected(spark, sf_small, store):
    tgt = TargetSpec(kind="parquet", path=scratch_path(spark, "up_all_rej"))
    first = orders_spec(spark, sf_small, target=tgt)
    run_job(spark, first, store)
    spec = orders_spec(spark, sf_small, target=tgt, load_strategy="UPSERT", upsert_keys=("o_orderkey",),
                       mappings=(M("ghost", "nope", 0),), rules=(V("NOT_NULL", "ghost"),), keep_unmapped=True)
    res = run_job(spark, spec, store, raise_on_error=False)
    assert res.status == "FAILED" or res.success_count == 0


def test_upsert_run_with_every_row_rejected(spark, sf_small, store):
    """All source rows rejected by an always-true rule: the UPSERT must not
    wait on metrics of a plan Catalyst pruned to empty."""
    tgt = TargetSpec(kind="parquet", path=scratch_path(spark, "up_rej_all"))
    run_job(spark, orders_spec(spark, sf_small, target=tgt), store)
    spec = orders_spec(spark, sf_small, target=tgt, load_strategy="UPSERT", upsert_keys=("o_orderkey",),
                       mappings=(M("o_orderstatus", "no_such", 0),), rules=(V("NOT_NULL", "o_orderstatus"),))
    res = run_job(spark, spec, store)
    n = spark.read.parquet(f"{sf_small}/orders.parquet").count()
    assert res.status == "SUCCESS" and res.success_count == 0 and res.rejected_rows == n
    assert spark.read.parquet(tgt.path).count() == n


def test_upsert_broadcast_and_shuffle_plans_agree(spark, sf_small):
    from tidewater.operators.merge import upsert
    from tidewater.plans.catalog_flow import _upsert_source
    o = spark.read.parquet(f"{sf_small}/orders.parquet")
    tgt = o.where(F.col("o_orderdate") < "1998-01-01").withColumn("load_note", F.lit("initial"))
    src = _upsert_source(spark, sf_small)
    a = upsert(tgt, src, ["o_orderkey"], "version", plan="auto", broadcast_limit=1 << 40)
    b = upsert(tgt, src, ["o_orderkey"], "version", plan="auto", broadcast_limit=0)
    c = upsert(tgt, src, ["o_orderkey"], "version")
    ra, rb, rc = (sorted(map(tuple, x.collect()), key=repr) for x in (a, b, c))
    assert ra == rb == rc
    assert "BroadcastHashJoin" in a._jdf.queryExecution().executedPlan().toString()


def test_run_removes_its_intermediate_folders(spark, sf_small, store):
    import os
    from tidewater.session import ensure_checkpoint_dir, local_path
    base = local_path(ensure_checkpoint_dir(spark) + "/tidewater-scratch")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    tgt = TargetSpec(kind="parquet", path=scratch_path(spark, "scope_tgt"))
    run_job(spark, orders_spec(spark, sf_small, target=tgt), store)
    spec = orders_spec(spark, sf_small, target=tgt, load_strategy="UPSERT", upsert_keys=("o_orderkey",),
                       rules=(V("UNIQUE", "o_custkey", {}, "WARN"),), row_index=True)
    run_job(spark, spec, store)
    new = set(os.listdir(base)) - before
    assert not [n for n in new if n.startswith(("dupkeys-", "upsert-source-", "rowindex-"))], new


def test_store_compaction_keeps_history(spark, sf_small):
    import glob
    from tidewater.session import local_path
    from datetime import timedelta
    store = RunStore(spark, scratch_path(spark, "compact_store"))
    for _ in range(3):
        run_job(spark, orders_spec(spark, sf_small, name="c"), store)
    before = sorted(map(tuple, store.runs().select("id", "status", "success_count").collect()))
    files = lambda: glob.glob(local_path(store.path("run_records")) + "/job=*/day=*/*.parquet")
    assert len(files()) == 3
    assert store.compact() == 0 and len(files()) == 3  # today is not closed
    assert store.compact(before=utcnow().date() + timedelta(days=1)) == 3 and len(files()) == 1
    assert sorted(map(tuple, store.runs().select("id", "status", "success_count").collect())) == before
    assert store.logs().count() > 0
    run_job(spark, orders_spec(spark, sf_small, name="c"), store)  # a record beside the compacted ones
    assert store.runs().count() == 4 and store.compact(before=utcnow().date() + timedelta(days=1)) == 2


def test_a_mark_reads_only_its_job_and_the_days_behind_the_snapshot(spark):
    import datetime as dt
    store = RunStore(spark, scratch_path(spark, "mark_store"))
    for job in ("a", "b"):
        for day in range(1, 6):
            when = dt.datetime(2024, 1, day, 12)
            store.append_run({"id": f"{job}{day}", "pipeline_id": job, "status": "SUCCESS", "run_type": "MANUAL", "started_at": when, "finished_at": when, "duration_seconds": 1.0,
                              "source_count": 1, "target_count": 1, "success_count": 1, "error_count": 0, "rejected_count": 0, "rejected_rows": 0, "error_message": None, "error_detail": None,
                              "created_at": when, "checkpoint_column": "k", "checkpoint_value": f"{job}{day}"}, [])
    full = sorted((r.pipeline_id, r.checkpoint_value) for r in store.marks().collect())
    store.compact(before=dt.date(2024, 1, 4))
    assert full == [("a", "a5"), ("b", "b5")] == sorted((r.pipeline_id, r.checkpoint_value) for r in store.marks().collect())
    assert store.mark_of("a")["checkpoint_value"] == "a5" and store.mark_of("c") is None
    plan = store.marks("a")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "day#" in line)
    assert "PartitionFilters" in scan and "job" in scan.split("PartitionFilters")[1] and "(day" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    # a mark that only the snapshot holds
    store.compact(before=dt.date(2024, 1, 20))
    assert store.mark_of("b")["checkpoint_value"] == "b5" and store.records("b", since=dt.date(2024, 1, 20)).count() == 0


def test_row_numbers_of_files_write_nothing(spark, sf_small):
    """Numbers come from the scan: the plan of the violations has no other source, and nothing is materialised."""
    import os
    from tidewater.session import ensure_checkpoint_dir, local_path
    src = scratch_path(spark, "rownum_src")
    spark.range(100).selectExpr("id as k", "id % 10 as v").repartitionByRange(4, "k").sortWithinPartitions("k").write.parquet(src)
    base = local_path(ensure_checkpoint_dir(spark) + "/tidewater-scratch")
    before = set(os.listdir(base))
    store = RunStore(spark, scratch_path(spark, "rownum_store"))
    spec = JobSpec(name="rn", source=SourceSpec(kind="parquet", path=src), target=TargetSpec(kind="parquet", path=scratch_path(spark, "rownum")), row_index=True, row_key=("k",),
                   rules=(V("RANGE", "v", {"max": 7}),), load_strategy="FULL_LOAD")
    run_job(spark, spec, store)
    assert not [n for n in set(os.listdir(base)) - before if n.startswith("rowindex-")]
    got = {(r.k, r.row_number) for r in store.violations().collect()}
    assert got == {(k, k) for k in range(100) if k % 10 > 7}
    assert spark.read.parquet(spec.target.path).columns == ["k", "v"]


def test_a_deep_page_is_a_filter_and_a_top_k(spark):
    from tidewater.operators import history
    df = spark.range(1000).selectExpr("id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id / 3 as int)) as created_at")
    rows, token = [], None
    while page := history.page_after(df, token, 300).collect():
        rows += [r.id for r in page]
        token = history.page_token(page[-1])
    assert rows == list(range(999, -1, -1))
    plan = history.page_after(df, token, 300)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Offset" not in plan


def test_history_over_a_real_store(spark, sf_small):
    from tidewater.errors import ValidationStop
    from tidewater.plans.store import utcnow
    store = RunStore(spark, scratch_path(spark, "hist_store"))
    run_job(spark, orders_spec(spark, sf_small, name="a"), store)
    run_job(spark, orders_spec(spark, sf_small, name="b", rules=(V("RANGE", "o_totalprice", {"max": 300000}),),
                               row_key=("o_orderkey",)), store)
    with pytest.raises(ValidationStop):
        run_job(spark, orders_spec(spark, sf_small, name="c", row_key=("o_orderkey",),
                                   rules=(V("RANGE", "o_totalprice", {"max": 1000}, "STOP"),)), store)
    pipelines = spark.createDataFrame([("a", "A", "ACTIVE"), ("b", "B", "ACTIVE"), ("x", "X", "DRAFT")],
                                      "id string, name string, status string")
    d = history.dashboard(pipelines, store.runs(), as_of=utcnow()).collect()[0]
    assert (d.total_pipelines, d.active_pipelines, d.today_success_jobs, d.today_failed_jobs) == (3, 2, 2, 1)
    n = spark.read.parquet(f"{sf_small}/orders.parquet")
    assert d.today_rows_transferred == n.count() + n.where("o_totalprice <= 300000").count()
    failed = history.list_runs(store.runs(), status="failed").collect()
    assert len(failed) == 1 and failed[0].pipeline_id == "c"
    stages = [r.stage for r in history.run_log(store.logs(), failed[0].id, order_cols=("seq",)).collect()]
    assert stages[-1] == "JOB_FAILED"
    kept = history.rejected_of_run(store.violations(), failed[0].id, limit=5, order_cols=("o_orderkey",)).collect()
    assert len(kept) == 5 and all(r.error_rule == "RANGE" for r in kept)
    recent = history.recent_runs(store.runs(), pipelines, limit=2).collect()
    assert [r.pipeline_name for r in recent] == ["—", "B"]
    prof = {(r.error_rule, r.error_column): r.violations for r in history.violation_profile(store.violations()).collect()}
    assert prof[("RANGE", "o_totalprice")] == n.where("o_totalprice > 300000").count() + n.where("o_totalprice > 1000").count()


def test_cached_run_matches(spark, sf_small, store):
    spec = orders_spec(spark, sf_small, rules=(V("RANGE", "o_totalprice", {"max": 300000}),), cache=True)
    res = run_job(spark, spec, store)
    n = spark.read.parquet(f"{sf_small}/orders.parquet")
    assert res.success_count == n.where("o_totalprice <= 300000").count()
    assert res.rejected_count == n.where("o_totalprice > 300000").count()


def test_mark_from_source_includes_rejected_rows(spark, sf_small, store):
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    src_dir = scratch_path(spark, "mfs_src")
    ev.write.parquet(src_dir)
    newest = ev.orderBy(F.col("ts").desc()).first()
    rule = (V("RANGE", "event_id", {"max": newest.event_id - 1}),)  # rejects the newest row (and any later ids)
    base = dict(name="mfs", source=SourceSpec(kind="parquet", path=src_dir, checkpoint_col="ts"),
                load_strategy="INCREMENTAL", rules=rule)
    valid_mark = run_job(spark, JobSpec(target=TargetSpec(kind="parquet", path=scratch_path(spark, "mfs_a")),
                                        **base), RunStore(spark, scratch_path(spark, "mfs_sa"))).mark
    source_mark = run_job(spark, JobSpec(target=TargetSpec(kind="parquet", path=scratch_path(spark, "mfs_b")),
                                         mark_from="source", **base), RunStore(spark, scratch_path(spark, "mfs_sb"))).mark
    assert source_mark == str(newest.ts)
    assert valid_mark is not None and valid_mark < source_mark


def test_empty_source_with_rules_leaves_target(spark, sf_small, store):
    """An empty source is a NO_DATA success whether or not rules apply, and a
    FULL_LOAD target is not truncated."""
    tgt = TargetSpec(kind="parquet", path=scratch_path(spark, "empty_rules_tgt"))
    run_job(spark, orders_spec(spark, sf_small, target=tgt), store)
    empty_src = SourceSpec(kind="sql", query="select * from tw_orders_empty")
    spark.read.parquet(f"{sf_small}/orders.parquet").where("false").createOrReplaceTempView("tw_orders_empty")
    for rules in ((V("RANGE", "o_totalprice", {"max": 1}),), (V("NOT_NULL", "no_such_column"),)):
        res = run_job(spark, orders_spec(spark, sf_small, source=empty_src, target=tgt, rules=rules), store)
        assert res.status == "SUCCESS" and res.source_count == 0 and res.success_count == 0
        assert spark.read.parquet(tgt.path).count() == 1500


def test_skipped_rules_keep_the_true_source_count(spark, sf_small, store):
    spec = orders_spec(spark, sf_small, rules=(V("NOT_NULL", "no_such_column"),))
    res = run_job(spark, spec, store)
    assert res.source_count == 1500 and res.success_count == 1500


def test_failed_run_does_not_move_the_mark(spark, sf_small, store):
    from tidewater.errors import ValidationStop
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    src_dir = scratch_path(spark, "markfail_src")
    ev.where("ts < '2024-01-10'").write.parquet(src_dir)
    base = dict(name="markfail", source=SourceSpec(kind="parquet", path=src_dir, checkpoint_col="ts"),
                target=TargetSpec(kind="parquet", path=scratch_path(spark, "markfail_tgt")),
                load_strategy="INCREMENTAL")
    first = run_job(spark, JobSpec(**base), store)
    ev.where("ts >= '2024-01-10' and ts < '2024-01-20'").write.mode("append").parquet(src_dir)
    with pytest.raises(ValidationStop):
        run_job(spark, JobSpec(rules=(V("RANGE", "value", {"max": -1}, "STOP"),), **base), store)
    assert store.mark_of("markfail")["checkpoint_value"] == first.mark
    third = run_job(spark, JobSpec(**base), store)  # re-reads what the failed run did not load
    assert third.source_count == ev.where("ts >= '2024-01-10' and ts < '2024-01-20'").count()
    assert store.mark_of("markfail")["checkpoint_value"] == third.mark > first.mark
