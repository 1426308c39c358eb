"""Driver queries for loads (L), sources (S), incremental / streaming (I),
drift (D), run history (R) and whole runs (E).

Queries that load data write below a fresh folder in the shared checkpoint
folder (``spark.checkpoint.dir``) and return the target read back, so the
result is what a later reader of the target sees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.rules import rule_message
from tidewater.operators import history
from tidewater.operators.drift import schema_drift
from tidewater.operators.mapping import auto_map
from tidewater.operators.validate import validate
from tidewater.plans.catalog_core import sql_str, table
from tidewater.plans.runner import run_job
from tidewater.plans.store import RunStore
from tidewater.session import scratch_path
from tidewater.sources.readers import describe, preview, read_source
from tidewater.sources.sinks import write_frame
from tidewater.spec import ColumnMapping as M
from tidewater.spec import JobSpec, SourceSpec, TargetSpec
from tidewater.spec import TransformRule as R
from tidewater.spec import ValidationRule as V


def _target(spark: SparkSession, name: str, kind: str = "parquet", **kw) -> TargetSpec:
    return TargetSpec(kind=kind, path=scratch_path(spark, name), **kw)


ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


# ======================================================================= L
def l_append(spark, d):
    o = table(spark, d, "orders")
    t = _target(spark, "l_append")
    write_frame(spark, o.where(F.col("o_orderdate") < "1997-01-01"), t, "FULL_LOAD")
    write_frame(spark, o.where(F.col("o_orderdate") >= "1997-01-01"), t, "APPEND")
    return spark.read.parquet(t.path)


L_APPEND_SQL = "select * from orders"


def l_full_load(spark, d):
    c = table(spark, d, "customer")
    t = _target(spark, "l_full_load", defaults={"c_note": "fresh"})
    write_frame(spark, c.where(F.col("c_acctbal") < 0).withColumn("c_note", F.lit("old")), t, "FULL_LOAD")
    write_frame(spark, c, t, "FULL_LOAD")  # keeps the target schema: c_note from the default
    return spark.read.parquet(t.path)


L_FULL_LOAD_SQL = "select *, 'fresh' as c_note from customer"


def l_truncate_insert(spark, d):
    s = table(spark, d, "supplier")
    t = _target(spark, "l_truncate_insert")
    write_frame(spark, s.select(F.lit(True).alias("s_flag"), "*"), t, "FULL_LOAD")
    write_frame(spark, s.where(F.col("s_acctbal") > 0), t, "TRUNCATE_INSERT")
    return spark.read.parquet(t.path)


L_TRUNCATE_INSERT_SQL = "select cast(null as boolean) as s_flag, * from supplier where s_acctbal > 0"


def _upsert_source(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

    def version(where, status, v, null_key=False):
        sel = [F.lit(None).cast("bigint").alias("o_orderkey") if null_key and c == "o_orderkey" else
               F.lit(status).alias(c) if c == "o_orderstatus" else F.col(c) for c in cols]
        return o.where(where).select(*sel, F.lit(v).alias("version"))

    return (version(F.col("o_orderdate") >= "1997-01-01", "U", 1)
            .unionByName(version(F.col("o_orderdate") >= "1999-01-01", "V", 2))
            .unionByName(version(F.col("o_orderdate") >= "2001-01-01", "N", 3, null_key=True)))


def l_upsert(spark, d):
    o = table(spark, d, "orders")
    t = _target(spark, "l_upsert")
    write_frame(spark, o.where(F.col("o_orderdate") < "1998-01-01").withColumn("load_note", F.lit("initial")),
                t, "FULL_LOAD")
    write_frame(spark, _upsert_source(spark, d), t, "UPSERT", upsert_keys=["o_orderkey"], order_by="version")
    return spark.read.parquet(t.path)


L_UPSERT_SQL = f"""
with src as (
  select o_orderkey, o_custkey, 'U' as o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 1 as version
    from orders where o_orderdate >= '1997-01-01'
  union all
  select o_orderkey, o_custkey, 'V', o_totalprice, o_orderdate, o_orderpriority, 2
    from orders where o_orderdate >= '1999-01-01'
  union all
  select null, o_custkey, 'N', o_totalprice, o_orderdate, o_orderpriority, 3
    from orders where o_orderdate >= '2001-01-01'),
keyed as (select * from src where o_orderkey is not null
          qualify row_number() over (partition by o_orderkey order by version desc) = 1),
tgt as (select {ORDER_COLS}, 'initial' as load_note from orders where o_orderdate < '1998-01-01')
select coalesce(s.o_orderkey, t.o_orderkey) as o_orderkey,
       case when s.o_orderkey is not null then s.o_custkey else t.o_custkey end as o_custkey,
       case when s.o_orderkey is not null then s.o_orderstatus else t.o_orderstatus end as o_orderstatus,
       case when s.o_orderkey is not null then s.o_totalprice else t.o_totalprice end as o_totalprice,
       case when s.o_orderkey is not null then s.o_orderdate else t.o_orderdate end as o_orderdate,
       case when s.o_orderkey is not null then s.o_orderpriority else t.o_orderpriority end as o_orderpriority,
       case when t.o_orderkey is not null then t.load_note end as load_note
from tgt t full outer join keyed s on t.o_orderkey = s.o_orderkey
union all
select {ORDER_COLS}, cast(null as varchar) from src where o_orderkey is null
"""


def l_upsert_partitioned(spark, d):
    """UPSERT into a target partitioned by a key column: only the partitions
    the source touches are read and rewritten."""
    o = table(spark, d, "orders").withColumn("o_year", F.year("o_orderdate"))
    t = _target(spark, "l_upsert_part", partition_by=("o_year",))
    write_frame(spark, o, t, "FULL_LOAD")
    src = (o.where(F.col("o_year") >= 1999).withColumn("o_orderstatus", F.lit("U"))
           .unionByName(o.where(F.col("o_year") == 2001).withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
                        .withColumn("o_orderstatus", F.lit("I"))))
    write_frame(spark, src, t, "UPSERT", upsert_keys=["o_orderkey", "o_year"])
    return spark.read.parquet(t.path)


L_UPSERT_PARTITIONED_SQL = f"""
select o_orderkey, o_custkey, case when year(o_orderdate) >= 1999 then 'U' else o_orderstatus end as o_orderstatus,
       o_totalprice, o_orderdate, o_orderpriority, cast(year(o_orderdate) as integer) as o_year
from orders
union all
select o_orderkey + 10000000, o_custkey, 'I', o_totalprice, o_orderdate, o_orderpriority, cast(year(o_orderdate) as integer)
from orders where year(o_orderdate) = 2001
"""


def l_overwrite(spark, d):
    t = _target(spark, "l_overwrite")
    write_frame(spark, table(spark, d, "region"), t, "FULL_LOAD")
    write_frame(spark, table(spark, d, "nation"), t, "OVERWRITE")  # rows and schema replaced
    return spark.read.parquet(t.path)


L_OVERWRITE_SQL = "select * from nation"


def l_align(spark, d):
    p = table(spark, d, "part")
    t = _target(spark, "l_align", defaults={"p_note": "appended"})
    seed = p.where(F.col("p_size") < 10).select("p_size", "p_partkey", "p_name", "p_retailprice", "p_brand", "p_type",
                                                 F.lit("seed").alias("p_note"))
    write_frame(spark, seed, t, "FULL_LOAD")
    write_frame(spark, p.where(F.col("p_size") >= 10), t, "APPEND")  # by name, missing p_note -> default
    return spark.read.parquet(t.path)


L_ALIGN_SQL = """
select p_size, p_partkey, p_name, p_retailprice, p_brand, p_type,
       case when p_size < 10 then 'seed' else 'appended' end as p_note
from part
"""


def l_incremental_append(spark, d):
    """INCREMENTAL writes append (the selection happens on the read side)."""
    e = table(spark, d, "events")
    t = _target(spark, "l_incremental")
    write_frame(spark, e.where(F.col("ts") < "2024-01-10"), t, "INCREMENTAL")
    write_frame(spark, e.where(F.col("ts") >= "2024-01-10"), t, "INCREMENTAL")
    return spark.read.parquet(t.path)


L_INCREMENTAL_APPEND_SQL = "select * from events"


def l_csv_roundtrip(spark, d):
    t = _target(spark, "l_csv", kind="csv", options={"delimiter": ";"})
    write_frame(spark, table(spark, d, "customer"), t, "FULL_LOAD")
    return read_source(spark, SourceSpec(kind="csv", path=t.path, options={"delimiter": ";"}))


L_CSV_ROUNDTRIP_SQL = ("select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment "
                       "from customer")


# ======================================================================= S
S_CSV_TEXT = ("c_custkey", "c_name",
              "case when c_custkey % 7 = 0 then 'null' else cast(c_nationkey as string) end AS c_nationkey",
              "c_acctbal",
              "case when c_custkey % 5 = 0 then 'NULL' when c_custkey % 5 = 1 then 'N/A' "
              "when c_custkey % 5 = 2 then 'NA' else c_mktsegment end AS c_mktsegment",
              "case when c_custkey % 3 = 0 then '' else 'x' end AS note")


def s_csv_nulls(spark, d):
    t = _target(spark, "s_csv_nulls", kind="csv", options={"delimiter": "\t"})
    write_frame(spark, table(spark, d, "customer").selectExpr(*S_CSV_TEXT), t, "FULL_LOAD")
    return read_source(spark, SourceSpec(kind="tsv", path=t.path))


S_CSV_NULLS_SQL = """
select c_custkey, c_name,
       case when c_custkey % 7 = 0 then null else cast(c_nationkey as bigint) end as c_nationkey,
       c_acctbal,
       case when c_custkey % 5 in (0, 1, 2) then null else c_mktsegment end as c_mktsegment,
       case when c_custkey % 3 = 0 then null else 'x' end as note
from customer
"""


def s_csv_charset(spark, d):
    """A Turkish ISO-8859-9 file (written by Spark's CSV writer) read back."""
    t = _target(spark, "s_csv_charset", kind="csv", options={"delimiter": "|", "encoding": "ISO-8859-9"})
    src = table(spark, d, "customer").select(
        "c_custkey", F.concat(F.col("c_name"), F.lit(" Iğdır Şişe")).alias("c_name"), "c_mktsegment")
    write_frame(spark, src, t, "FULL_LOAD")
    return read_source(spark, SourceSpec(kind="csv", path=t.path,
                                         options={"delimiter": "|", "encoding": "ISO-8859-9"}))


S_CSV_CHARSET_SQL = "select c_custkey, c_name || ' Iğdır Şişe' as c_name, c_mktsegment from customer"


def _views(spark, d, *names):
    for n in names:
        table(spark, d, n).createOrReplaceTempView(f"tw_{n}")


def s_sql(spark, d):
    _views(spark, d, "lineitem", "orders")
    q = ("select l.l_orderkey, l.l_linenumber, o.o_custkey, l.l_quantity * l.l_extendedprice as line_total "
         "from tw_lineitem l join tw_orders o on l.l_orderkey = o.o_orderkey where o.o_orderstatus = 'F'")
    return read_source(spark, SourceSpec(kind="sql", query=q))


S_SQL_SQL = ("select l.l_orderkey, l.l_linenumber, o.o_custkey, l.l_quantity * l.l_extendedprice as line_total "
             "from lineitem l join orders o on l.l_orderkey = o.o_orderkey where o.o_orderstatus = 'F'")


def s_describe(spark, d):
    return describe(spark, table(spark, d, "orders"))


S_DESCRIBE_SQL = """
select distinct column_name as name,
       case data_type when 'TIMESTAMP' then 'TIMESTAMP' when 'VARCHAR' then 'VARCHAR' else data_type end as data_type,
       true as is_nullable, cast(null as integer) as precision, cast(null as integer) as scale,
       cast(null as integer) as max_length, cast(ordinal_position - 1 as integer) as ordinal_position
from information_schema.columns where table_name = 'orders'
"""


def s_preview(spark, d):
    return preview(table(spark, d, "orders"), 500, order_by=["o_orderkey"])  # capped at 100


S_PREVIEW_SQL = "select * from orders order by o_orderkey limit 100"


def s_test_run(spark, d):
    """A TEST run reads at most 100 rows (ordered source) and writes nothing."""
    store = RunStore(spark, scratch_path(spark, "s_test_run_store"))
    src = SourceSpec(kind="sql", query="select * from tw_orders order by o_orderkey")
    _views(spark, d, "orders")
    spec = JobSpec(name="s_test_run", source=src, target=_target(spark, "s_test_run"),
                   rules=(V("RANGE", "o_totalprice", {"max": 300000}),))
    res = run_job(spark, spec, store, run_type="TEST")
    return store.runs().where(F.col("id") == res.run_id).select("run_type", "status", "source_count", "success_count",
                                                                "rejected_count")


S_TEST_RUN_SQL = """
with s as (select * from orders order by o_orderkey limit 100)
select 'TEST' as run_type, 'SUCCESS' as status, count(*) as source_count,
       cast(count_if(o_totalprice <= 300000) as bigint) as success_count,
       cast(count_if(o_totalprice > 300000) as bigint) as rejected_count from s
"""


# ======================================================================= I
def i_scan(spark, d):
    src = SourceSpec(kind="parquet", path=f"{d}/events.parquet", checkpoint_col="ts")
    return read_source(spark, src, checkpoint_value="2024-01-15 00:00:00")


I_SCAN_SQL = "select * from events where ts > timestamp '2024-01-15 00:00:00'"


def i_scan_pruned(spark, d):
    """Incremental scan of a date-partitioned copy of events: the mark prunes
    whole partitions, and a one-day lookback re-reads late rows."""
    p = scratch_path(spark, "i_scan_pruned")
    table(spark, d, "events").withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(p)
    src = SourceSpec(kind="parquet", path=p, checkpoint_col="ts",
                     options={"mark_partition_column": "dt", "lookback": "1 DAY"})
    return read_source(spark, src, checkpoint_value="2024-01-20 12:00:00").drop("dt")


I_SCAN_PRUNED_SQL = "select * from events where ts > timestamp '2024-01-19 12:00:00'"


def _two_slice_runs(spark, d, name: str):
    e = table(spark, d, "events")
    src_dir = scratch_path(spark, f"{name}_src")
    store = RunStore(spark, scratch_path(spark, f"{name}_store"))
    spec = JobSpec(name=name, source=SourceSpec(kind="parquet", path=src_dir, checkpoint_col="ts"),
                   target=_target(spark, f"{name}_tgt"), load_strategy="INCREMENTAL")
    e.where(F.col("ts") < "2024-01-15").write.parquet(src_dir)
    r1 = run_job(spark, spec, store)
    e.where(F.col("ts") >= "2024-01-15").write.mode("append").parquet(src_dir)
    r2 = run_job(spark, spec, store)
    return spec, store, (r1, r2)


def i_two_slices(spark, d):
    spec, _store, _ = _two_slice_runs(spark, d, "i_two_slices")
    return spark.read.parquet(spec.target.path)


I_TWO_SLICES_SQL = "select * from events"


def i_mark(spark, d):
    _spec, store, _ = _two_slice_runs(spark, d, "i_mark")
    return store.marks().select("pipeline_id", "checkpoint_column", "checkpoint_value")


I_MARK_SQL = """
select 'i_mark' as pipeline_id, 'ts' as checkpoint_column,
       case when microsecond(max(ts)) % 1000000 = 0 then strftime(max(ts), '%Y-%m-%d %H:%M:%S')
            else strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') end as checkpoint_value
from events
"""


def i_run_counts(spark, d):
    _spec, store, _ = _two_slice_runs(spark, d, "i_run_counts")
    return store.runs().select("status", "run_type", "source_count", "success_count", "rejected_count")


I_RUN_COUNTS_SQL = """
select 'SUCCESS' as status, 'MANUAL' as run_type, count(*) as source_count, count(*) as success_count,
       cast(0 as bigint) as rejected_count
from events group by ts < timestamp '2024-01-15 00:00:00'
"""


def i_no_data(spark, d):
    """A second INCREMENTAL run with nothing new: SUCCESS with zero rows, no
    write, mark unchanged (the run records of both runs)."""
    e = table(spark, d, "events")
    src_dir = scratch_path(spark, "i_no_data_src")
    e.write.parquet(src_dir)
    store = RunStore(spark, scratch_path(spark, "i_no_data_store"))
    spec = JobSpec(name="i_no_data", source=SourceSpec(kind="parquet", path=src_dir, checkpoint_col="ts"),
                   target=_target(spark, "i_no_data_tgt"), load_strategy="INCREMENTAL")
    run_job(spark, spec, store)
    run_job(spark, spec, store)
    return store.runs().select("status", "source_count", "success_count",
                               F.col("checkpoint_value").isNotNull().alias("advanced_mark"))


I_NO_DATA_SQL = """
select 'SUCCESS' as status, count(*) as source_count, count(*) as success_count, true as advanced_mark from events
union all
select 'SUCCESS', cast(0 as bigint), cast(0 as bigint), false
"""


STREAM_RULES = (V("RANGE", "value", {"max": 400}),)
STREAM_MAPS = (M("event_type", "event_type", 0, transform_rules=(R("UPPER"),)),)


def i_stream(spark, d):
    """Micro-batches (one file each) through foreachBatch runs of the job."""
    from tidewater.streaming.scheduled import start_stream
    e = table(spark, d, "events")
    src_dir = scratch_path(spark, "i_stream_src")
    for lo, hi in (("2000-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2100-01-01")):
        e.where((F.col("ts") >= lo) & (F.col("ts") < hi)).write.mode("append").parquet(src_dir)
    store = RunStore(spark, scratch_path(spark, "i_stream_store"))
    spec = JobSpec(name="i_stream", source=SourceSpec(kind="parquet", path=src_dir),
                   target=_target(spark, "i_stream_tgt"), load_strategy="APPEND",
                   mappings=STREAM_MAPS, rules=STREAM_RULES)
    q = start_stream(spark, spec, src_dir, e.schema, store=store, max_files_per_trigger=1)
    q.awaitTermination()
    return spark.read.parquet(spec.target.path)


I_STREAM_SQL = "select event_id, ts, user_id, upper(event_type) as event_type, value, props from events where value <= 400"


# ======================================================================= D
DRIFT_INPUT = ("o_orderkey", "cast(o_custkey as int) AS o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "case when o_orderkey % 10 = 0 then null else o_orderpriority end AS o_orderpriority")
DRIFT_EXPECTED = T.StructType([
    T.StructField("o_orderkey", T.LongType(), False),
    T.StructField("o_custkey", T.LongType(), True),
    T.StructField("o_totalprice", T.DoubleType(), True),
    T.StructField("o_orderdate", T.DateType(), True),
    T.StructField("o_comment", T.StringType(), True),
    T.StructField("o_orderpriority", T.StringType(), False),
])


def d_drift(spark, d):
    return schema_drift(spark, table(spark, d, "orders").selectExpr(*DRIFT_INPUT), DRIFT_EXPECTED)


D_DRIFT_SQL = """
select * from (values ('o_custkey', 'type_changed', 'bigint', 'int', cast(null as bigint)),
                      ('o_orderdate', 'type_changed', 'date', 'timestamp_ntz', null),
                      ('o_comment', 'removed', 'string', null, null),
                      ('o_orderstatus', 'added', null, 'string', null))
       as v("column", change, expected, actual, null_count)
union all
select 'o_orderpriority', 'nullability', 'not null', 'null', count(*) - count(o_orderpriority)
from (select case when o_orderkey % 10 = 0 then null else o_orderpriority end as o_orderpriority from orders)
"""


# ======================================================================= R
RUNS = ("event_id AS id", "user_id * 11 AS pipeline_id",
        "case event_type when 'purchase' then 'SUCCESS' when 'click' then 'SUCCESS' when 'error' then 'FAILED' "
        "when 'view' then 'RUNNING' else 'PENDING' end AS status",
        "case when event_id % 3 = 0 then 'SCHEDULED' else 'MANUAL' end AS run_type",
        "ts AS created_at", "value AS duration_seconds", "cast(floor(value * 10) as bigint) AS success_count")
PIPELINES = ("c_custkey AS id", "c_name AS name",
             "case when c_acctbal >= 0 then 'ACTIVE' else 'INACTIVE' end AS status")
_R_WITH = f"with r as (select {', '.join(RUNS)} from events), p as (select {', '.join(PIPELINES)} from customer) "
AS_OF = "2024-01-29 13:00:00"


def _runs(spark, d):
    return table(spark, d, "events").selectExpr(*RUNS)


def _pipelines(spark, d):
    return table(spark, d, "customer").selectExpr(*PIPELINES)


def r_stats(spark, d):
    return history.dashboard(_pipelines(spark, d), _runs(spark, d), as_of=AS_OF)


R_STATS_SQL = _R_WITH + """
select (select count(*) from p) as total_pipelines,
       (select cast(count_if(status = 'ACTIVE') as bigint) from p) as active_pipelines,
       cast(count_if(created_at >= timestamp '2024-01-29 00:00:00' and status = 'SUCCESS') as bigint) as today_success_jobs,
       cast(count_if(created_at >= timestamp '2024-01-29 00:00:00' and status = 'FAILED') as bigint) as today_failed_jobs,
       cast(coalesce(sum(case when created_at >= timestamp '2024-01-29 00:00:00' and status = 'SUCCESS'
                              then success_count end), 0) as bigint) as today_rows_transferred,
       round(coalesce(avg(case when status = 'SUCCESS' then duration_seconds end), 0), 1) as avg_duration_seconds
from r
"""


def r_recent(spark, d):
    return history.recent_runs(_runs(spark, d), _pipelines(spark, d), limit=10)


R_RECENT_SQL = _R_WITH + """
select t.*, coalesce(p.name, '—') as pipeline_name
from (select * from r order by created_at desc, id desc limit 10) t left join p on t.pipeline_id = p.id
"""


def r_page(spark, d):
    return history.list_runs(_runs(spark, d), status="success", limit=50, offset=100)


R_PAGE_SQL = _R_WITH + "select * from r where status = 'SUCCESS' order by created_at desc, id desc limit 50 offset 100"


def r_page_filtered(spark, d):
    return history.list_runs(_runs(spark, d), pipeline_id=77, limit=20)


R_PAGE_FILTERED_SQL = _R_WITH + "select * from r where pipeline_id = 77 order by created_at desc, id desc limit 20"


LOGS = ("conv_id AS job_run_id", "cast(turn as int) AS seq",
        "case role when 'user' then 'INFO' when 'assistant' then 'WARN' else 'ERROR' end AS level",
        "upper(role) AS stage", "text AS message")


def r_log(spark, d):
    return history.run_log(table(spark, d, "conversations").selectExpr(*LOGS), order_cols=("seq",))


R_LOG_SQL = f"select {', '.join(LOGS)} from conversations"


def _orders_range_violations(spark, d):
    vo = validate(table(spark, d, "orders"), [V("RANGE", "o_totalprice", {"min": 2000, "max": 420000})], persist=False)
    return vo.violations(row_key=["o_orderkey"], include_source=False).drop("rule_index", "action")


def r_rejected(spark, d):
    return history.rejected_of_run(_orders_range_violations(spark, d), limit=100, order_cols=("o_orderkey",))


_R_MSG = sql_str(rule_message("RANGE", "o_totalprice", {"min": 2000, "max": 420000}))
R_REJECTED_SQL = (f"select o_orderkey, 'o_totalprice' as error_column, 'RANGE' as error_rule, {_R_MSG} as error_message "
                  "from orders where o_totalprice < 2000 or o_totalprice > 420000 order by o_orderkey limit 100")


def r_profile(spark, d):
    from tidewater.plans.catalog_core import _orders_outcome
    v = _orders_outcome(spark, d).violations(row_key=["o_orderkey"], include_source=False)
    return history.violation_profile(v)


def _r_profile_sql() -> str:
    from tidewater.plans.catalog_core import A_VIOLATIONS_SQL
    return (f"select error_rule, error_column, count(*) as violations from ({A_VIOLATIONS_SQL}) "
            "group by error_rule, error_column")


R_PROFILE_SQL = _r_profile_sql()


# ======================================================================= E
FACT_RULES = (
    V("RANGE", "o_totalprice", {"min": 1000, "max": 450000}),
    V("NOT_NULL", "status"),
    V("REGEX", "priority", {"pattern": "^[1-3]-"}, "WARN"),
)


def _fact_spec(spark, d) -> JobSpec:
    orders = table(spark, d, "orders")
    maps = auto_map(orders.schema)
    extra = {
        "o_orderpriority": M("priority", "o_orderpriority", 5, transform_rules=(R("TRIM"), R("UPPER", apply_order=1))),
        "o_orderstatus": M("status", "o_orderstatus", 2, transform_rules=(R("CASE_WHEN", {
            "conditions": [{"when": "F", "then": "DELIVERED"}, {"when": "O", "then": "PROCESSING"}],
            "else": None}),)),
    }
    maps = [extra.get(m.source_column, m) for m in maps]
    maps.append(M("currency", None, 10, is_constant=True, constant_value="TRY"))
    return JobSpec(name="orders_fact", source=SourceSpec(kind="parquet", path=f"{d}/orders.parquet"),
                   target=_target(spark, "e_orders_fact"), mappings=tuple(maps), rules=FACT_RULES,
                   load_strategy="FULL_LOAD", row_key=("o_orderkey",))


def e_orders_fact(spark, d):
    spec = _fact_spec(spark, d)
    run_job(spark, spec, RunStore(spark, scratch_path(spark, "e_orders_fact_store")))
    return spark.read.parquet(spec.target.path)


_FACT_BASE = """
with m as (select o_orderkey, o_custkey,
  case when o_orderstatus = 'F' then 'DELIVERED' when o_orderstatus = 'O' then 'PROCESSING' end as status,
  o_totalprice, o_orderdate, upper(o_orderpriority) as priority, 'TRY' as currency from orders)
"""
E_ORDERS_FACT_SQL = _FACT_BASE + ("select * from m where not (o_totalprice < 1000 or o_totalprice > 450000) "
                                  "and status is not null")


def e_run_record(spark, d):
    spec = _fact_spec(spark, d)
    store = RunStore(spark, scratch_path(spark, "e_run_record_store"))
    run_job(spark, spec, store)
    return store.runs().select("pipeline_id", "status", "source_count", "success_count", "rejected_count",
                               "rejected_rows")


E_RUN_RECORD_SQL = _FACT_BASE + """
select 'orders_fact' as pipeline_id, 'SUCCESS' as status, count(*) as source_count,
       cast(count_if(not (o_totalprice < 1000 or o_totalprice > 450000) and status is not null) as bigint) as success_count,
       cast(count_if(o_totalprice < 1000 or o_totalprice > 450000) + count_if(status is null)
         + count_if(not regexp_matches(priority, '^[1-3]-')) as bigint) as rejected_count,
       cast(count_if(o_totalprice < 1000 or o_totalprice > 450000 or status is null) as bigint) as rejected_rows
from m
"""


def e_quarantine(spark, d):
    """Violation records as stored by the run (typed source row kept)."""
    spec = _fact_spec(spark, d)
    store = RunStore(spark, scratch_path(spark, "e_quarantine_store"))
    run_job(spark, spec, store)
    return store.violations().select("pipeline_id", "o_orderkey", "error_column", "error_rule",
                                     F.col("source_data.o_totalprice").alias("o_totalprice"))


E_QUARANTINE_SQL = _FACT_BASE + """
select 'orders_fact' as pipeline_id, o_orderkey, 'o_totalprice' as error_column, 'RANGE' as error_rule, o_totalprice
  from m where o_totalprice < 1000 or o_totalprice > 450000
union all
select 'orders_fact', o_orderkey, 'status', 'NOT_NULL', o_totalprice from m where status is null
union all
select 'orders_fact', o_orderkey, 'priority', 'REGEX', o_totalprice from m where not regexp_matches(priority, '^[1-3]-')
"""


def e_json_spec(spark, d):
    """A pipeline stored as JSON in the original layout (source/target
    config, column mappings with ordered transform rules, validation rules
    naming their column through the mapping) runs unchanged."""
    import json

    from tidewater.spec import job_from_dict
    doc = json.loads(json.dumps({
        "name": "customers_dim",
        "source_config": {"kind": "parquet", "path": f"{d}/customer.parquet"},
        "target_config": {"kind": "parquet", "path": scratch_path(spark, "e_json_tgt"), "create_if_not_exists": True},
        "load_strategy": "FULL_LOAD",
        "column_mappings": [
            {"source_column": "c_custkey", "target_column": "customer_id", "ordinal_position": 0},
            {"source_column": "c_name", "target_column": "full_name", "ordinal_position": 1,
             "transform_rules": [{"transform_type": "REPLACE", "params": {"from": "^Customer#0*", "to": "C-"},
                                  "apply_order": 1},
                                 {"transform_type": "trim", "apply_order": 0}]},
            {"source_column": "c_mktsegment", "target_column": "segment", "ordinal_position": 2,
             "transform_rules": [{"transform_type": "LOWER", "apply_order": 0}]},
            {"source_column": "c_acctbal", "target_column": "c_acctbal", "ordinal_position": 3, "is_excluded": True},
            {"target_column": "country", "is_constant": True, "constant_value": "TR", "ordinal_position": 4},
        ],
        "validation_rules": [
            {"rule_type": "REGEX", "mapping": {"target_column": "full_name"}, "params": {"pattern": "^C-[1-9]"},
             "action_on_fail": "REJECT"},
            {"rule_type": "NOT_NULL", "mapping": {"target_column": "segment"}, "action_on_fail": "WARN"},
        ],
    }))
    spec = job_from_dict(doc)
    run_job(spark, spec, RunStore(spark, scratch_path(spark, "e_json_store")))
    return spark.read.parquet(spec.target.path)


E_JSON_SPEC_SQL = """
select c_custkey as customer_id, regexp_replace(c_name, '^Customer#0*', 'C-') as full_name, c_nationkey,
       lower(c_mktsegment) as segment, 'TR' as country
from customer
where regexp_matches(regexp_replace(c_name, '^Customer#0*', 'C-'), '^C-[1-9]')
"""


def e_dim_customers(spark, d):
    """Derived text through a SQL source, then an UPSERT of a second load."""
    _views(spark, d, "customer")
    store = RunStore(spark, scratch_path(spark, "e_dim_store"))
    tgt = _target(spark, "e_dim_customers")
    q1 = ("select c_custkey as customer_id, concat_ws(' ', 'Sayın', c_name) as full_name, c_mktsegment as segment "
          "from tw_customer where c_acctbal < 5000")
    q2 = ("select c_custkey as customer_id, upper(concat_ws(' ', 'Sayın', c_name)) as full_name, "
          "c_mktsegment as segment from tw_customer where c_acctbal >= 0")
    run_job(spark, JobSpec(name="dim_load", source=SourceSpec(kind="sql", query=q1), target=tgt), store)
    run_job(spark, JobSpec(name="dim_upsert", source=SourceSpec(kind="sql", query=q2), target=tgt,
                           load_strategy="UPSERT", upsert_keys=("customer_id",)), store)
    return spark.read.parquet(tgt.path)


E_DIM_CUSTOMERS_SQL = """
select c_custkey as customer_id,
       case when c_acctbal >= 0 then upper(concat_ws(' ', 'Sayın', c_name)) else concat_ws(' ', 'Sayın', c_name) end
         as full_name,
       c_mktsegment as segment
from customer
"""


def e_fact_items(spark, d):
    """Arithmetic through a SQL source (line total), appended to a fact table."""
    _views(spark, d, "lineitem")
    store = RunStore(spark, scratch_path(spark, "e_items_store"))
    q = ("select l_orderkey as order_id, l_linenumber as line_no, l_partkey as product_id, l_quantity as quantity, "
         "l_extendedprice as unit_price, l_quantity * l_extendedprice as line_total from tw_lineitem")
    spec = JobSpec(name="fact_items", source=SourceSpec(kind="sql", query=q), target=_target(spark, "e_fact_items"),
                   load_strategy="APPEND", rules=(V("RANGE", "quantity", {"min": 1}),))
    run_job(spark, spec, store)
    return spark.read.parquet(spec.target.path)


E_FACT_ITEMS_SQL = """
select l_orderkey as order_id, l_linenumber as line_no, l_partkey as product_id, l_quantity as quantity,
       l_extendedprice as unit_price, l_quantity * l_extendedprice as line_total
from lineitem where l_quantity >= 1
"""


QUERIES = {
    "l_append": (l_append, L_APPEND_SQL),
    "l_full_load": (l_full_load, L_FULL_LOAD_SQL),
    "l_truncate_insert": (l_truncate_insert, L_TRUNCATE_INSERT_SQL),
    "l_upsert": (l_upsert, L_UPSERT_SQL),
    "l_upsert_partitioned": (l_upsert_partitioned, L_UPSERT_PARTITIONED_SQL),
    "l_overwrite": (l_overwrite, L_OVERWRITE_SQL),
    "l_align": (l_align, L_ALIGN_SQL),
    "l_incremental_append": (l_incremental_append, L_INCREMENTAL_APPEND_SQL),
    "l_csv_roundtrip": (l_csv_roundtrip, L_CSV_ROUNDTRIP_SQL),
    "s_csv_nulls": (s_csv_nulls, S_CSV_NULLS_SQL),
    "s_csv_charset": (s_csv_charset, S_CSV_CHARSET_SQL),
    "s_sql": (s_sql, S_SQL_SQL),
    "s_describe": (s_describe, S_DESCRIBE_SQL),
    "s_preview": (s_preview, S_PREVIEW_SQL),
    "s_test_run": (s_test_run, S_TEST_RUN_SQL),
    "i_scan": (i_scan, I_SCAN_SQL),
    "i_scan_pruned": (i_scan_pruned, I_SCAN_PRUNED_SQL),
    "i_two_slices": (i_two_slices, I_TWO_SLICES_SQL),
    "i_mark": (i_mark, I_MARK_SQL),
    "i_run_counts": (i_run_counts, I_RUN_COUNTS_SQL),
    "i_no_data": (i_no_data, I_NO_DATA_SQL),
    "i_stream": (i_stream, I_STREAM_SQL),
    "d_drift": (d_drift, D_DRIFT_SQL),
    "r_stats": (r_stats, R_STATS_SQL),
    "r_recent": (r_recent, R_RECENT_SQL),
    "r_page": (r_page, R_PAGE_SQL),
    "r_page_filtered": (r_page_filtered, R_PAGE_FILTERED_SQL),
    "r_log": (r_log, R_LOG_SQL),
    "r_rejected": (r_rejected, R_REJECTED_SQL),
    "r_profile": (r_profile, R_PROFILE_SQL),
    "e_orders_fact": (e_orders_fact, E_ORDERS_FACT_SQL),
    "e_run_record": (e_run_record, E_RUN_RECORD_SQL),
    "e_quarantine": (e_quarantine, E_QUARANTINE_SQL),
    "e_json_spec": (e_json_spec, E_JSON_SPEC_SQL),
    "e_dim_customers": (e_dim_customers, E_DIM_CUSTOMERS_SQL),
    "e_fact_items": (e_fact_items, E_FACT_ITEMS_SQL),
}
