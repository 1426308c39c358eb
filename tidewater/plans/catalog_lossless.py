"""Driver queries for the inputs on which a load could lose or change values,
and for run records: whole tables, a DuckDB SQL each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.errors import JobError
from tidewater.operators import history
from tidewater.plans.catalog_core import R, M, V, _viol_sql, _violations, mapped, table
from tidewater.plans.catalog_flow import _target
from tidewater.plans.runner import run_job
from tidewater.plans.store import RunStore
from tidewater.session import scratch_path
from tidewater.sources.readers import list_tables, read_source
from tidewater.sources.sinks import read_target, write_frame
from tidewater.spec import JobSpec, SourceSpec
from tidewater.streaming.scheduled import start_stream


# ======================================================================= L
def _upsert_into_partitions(spark, d, name, p):
    """All orders, then the same with keys moved on by 3: known (key, partition) pairs are updated, others inserted."""
    rows = table(spark, d, "orders").selectExpr("o_orderkey as k", f"{p} as p", "o_totalprice as v")
    t = _target(spark, name, partition_by=("p",))
    write_frame(spark, rows, t, "FULL_LOAD")
    change = rows.select((F.col("k") + 3).alias("k"), "p", (-F.col("v")).alias("v"))
    write_frame(spark, change, t, "UPSERT", ("k", "p"))
    return read_target(spark, t, rows.schema).select("k", "p", "v")


def _upsert_sql(p):
    return f"""with t as (select o_orderkey as k, {p} as p, o_totalprice as v from orders),
s as (select k + 3 as k, p, -v as v from t)
select k, p, v from t where not exists (select 1 from s where s.k = t.k and s.p = t.p) union all select k, p, v from s"""


NULL_P, TEXT_P = "nullif(o_orderstatus, 'F')", "concat('0', substr(o_orderpriority, 1, 1))"


def l_upsert_null_partition(spark, d):
    return _upsert_into_partitions(spark, d, "l_upsert_null_partition", NULL_P)


def l_upsert_text_partition(spark, d):
    return _upsert_into_partitions(spark, d, "l_upsert_text_partition", TEXT_P)


def l_upsert_first_load(spark, d):
    rows = table(spark, d, "orders").selectExpr("case when o_orderstatus = 'F' then null else o_custkey end as k", "o_orderkey", "o_totalprice")
    t = _target(spark, "l_upsert_first_load")
    write_frame(spark, rows, t, "UPSERT", ("k",), "o_orderkey")
    return spark.read.parquet(t.path).select("k", "o_orderkey", "o_totalprice")


L_UPSERT_FIRST_LOAD_SQL = """with s as (select case when o_orderstatus = 'F' then null else o_custkey end as k, o_orderkey, o_totalprice from orders)
select k, o_orderkey, o_totalprice from s where k is null
union all select k, max(o_orderkey), arg_max(o_totalprice, o_orderkey) from s where k is not null group by k"""


def _refused(spark, d, name, change, strategy, keys=()):
    """The error code of a load that must not happen, and the rows of the target after it."""
    t = _target(spark, name)
    write_frame(spark, table(spark, d, "orders").selectExpr("cast(o_orderkey as int) as k", "cast(o_custkey as int) as v"), t, "FULL_LOAD")
    try:
        write_frame(spark, table(spark, d, "orders").selectExpr(*change), t, strategy, keys)
        code = "OK"
    except JobError as e:
        code = e.code
    return spark.read.parquet(t.path).agg(F.lit(code).alias("code"), F.count("*").alias("n"), F.sum("v").alias("s"))


_REFUSED_SQL = "select 'WRITE_FAILED' as code, count(*) as n, cast(sum(o_custkey) as bigint) as s from orders"


def l_upsert_narrow_target(spark, d):
    return _refused(spark, d, "l_upsert_narrow_target", ("o_orderkey as k", "o_custkey + 3000000000 as v"), "UPSERT", ("k",))


def l_append_type_conflict(spark, d):
    return _refused(spark, d, "l_append_type_conflict", ("o_orderkey as k", "o_orderstatus as v"), "APPEND")


def l_missing_target(spark, d):
    """create_if_not_exists off: the load is refused, nothing is written."""
    t = _target(spark, "l_missing_target", create_if_not_exists=False)
    rows = table(spark, d, "customer")
    try:
        write_frame(spark, rows, t, "APPEND")
        code = "OK"
    except JobError as e:
        code = e.code
    return rows.agg(F.lit(code).alias("code"), F.lit(read_target(spark, t) is None).alias("still_missing"), F.count("*").alias("offered"))


L_MISSING_TARGET_SQL = "select 'TABLE_NOT_FOUND' as code, true as still_missing, count(*) as offered from customer"


def l_csv_upsert_text(spark, d):
    """A CSV target's text (leading zeros, trailing zeros, null tokens) is not retyped by an UPSERT."""
    t = _target(spark, "l_csv_upsert_text", kind="csv")
    base = table(spark, d, "customer").selectExpr("lpad(cast(c_custkey as string), 9, '0') as k", "'NA' as a", "concat(cast(c_nationkey as string), '.50') as b")
    write_frame(spark, base, t, "FULL_LOAD")
    write_frame(spark, table(spark, d, "supplier").selectExpr("lpad(cast(s_suppkey as string), 9, '0') as k", "s_name as a", "'007' as b"), t, "UPSERT", ("k",))
    return read_target(spark, t)


L_CSV_UPSERT_TEXT_SQL = """with t as (select lpad(cast(c_custkey as varchar), 9, '0') as k, 'NA' as a, cast(c_nationkey as varchar) || '.50' as b from customer),
s as (select lpad(cast(s_suppkey as varchar), 9, '0') as k, s_name as a, '007' as b from supplier)
select * from s union all select * from t where k not in (select k from s)"""


# ======================================================================= S
def s_csv_quoted(spark, d):
    """Whole document texts through CSV: quotes, separators and line breaks come back as they were."""
    t = _target(spark, "s_csv_quoted", kind="csv")
    write_frame(spark, table(spark, d, "documents").selectExpr("doc_id", "concat('\"', text, '\",', chr(10), 'end') as text", "n_chars"), t, "FULL_LOAD")
    return read_source(spark, SourceSpec(kind="csv", path=t.path))


S_CSV_QUOTED_SQL = """select doc_id, '"' || text || '",' || chr(10) || 'end' as text, n_chars from documents"""


def s_csv_big_ints(spark, d):
    t = _target(spark, "s_csv_big_ints", kind="csv")
    write_frame(spark, table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "concat('12345678901', lpad(cast(l_orderkey as string), 10, '0')) as big"), t, "FULL_LOAD")
    return read_source(spark, SourceSpec(kind="csv", path=t.path))


S_CSV_BIG_INTS_SQL = """select l_orderkey, cast(l_linenumber as bigint) as l_linenumber,
'12345678901' || lpad(cast(l_orderkey as varchar), 10, '0') as big from lineitem"""


def s_list_tables(spark, d):
    """The catalog's tables and views, with orders and customers registered there."""
    names = ["s_list_customer", "s_list_orders"]
    for n in names:
        table(spark, d, n[7:]).createOrReplaceTempView(n)
    listed = list_tables(spark).select("name", F.lit(True).alias("listed"))
    counts = None
    for n in names:
        one = spark.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    return counts.join(listed, "name")


S_LIST_TABLES_SQL = """select 's_list_customer' as name, true as listed, count(*) as n from customer
union all select 's_list_orders', true, count(*) from orders"""


# ======================================================================= V, T
LINE_KEY = ["l_orderkey", "l_linenumber"]


def _range(name, expr, params):
    def query(spark, d):
        df = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{expr} as x")
        return _violations(df, [V("RANGE", "x", params)], LINE_KEY)
    query.__name__ = name
    return query


v_range_fraction_on_int = _range("v_range_fraction_on_int", "cast(l_linenumber as int)", {"min": 1.5, "max": 4.5})
V_RANGE_FRACTION_SQL = _viol_sql("lineitem", "l_orderkey, l_linenumber", "l_linenumber < 1.5 or l_linenumber > 4.5", "x", "RANGE", {"min": 1.5, "max": 4.5})
v_range_outside_type = _range("v_range_outside_type", "cast(l_linenumber as int)", {"min": 3000000000})
V_RANGE_OUTSIDE_SQL = _viol_sql("lineitem", "l_orderkey, l_linenumber", "l_linenumber < 3000000000", "x", "RANGE", {"min": 3000000000})
v_range_decimal = _range("v_range_decimal", "cast(l_discount as decimal(10, 2))", {"min": "0.015", "max": "0.085"})
V_RANGE_DECIMAL_SQL = _viol_sql("lineitem", "l_orderkey, l_linenumber", "cast(l_discount as decimal(10, 2)) < 0.015 or cast(l_discount as decimal(10, 2)) > 0.085",
                                "x", "RANGE", {"min": "0.015", "max": "0.085"})


def t_fill_outside_type(spark, d):
    df = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "nullif(cast(l_linenumber as int), 3) as x")
    return mapped(df, [M("x", "x", 0, transform_rules=(R("COALESCE", {"default": 3000000000}),))])


T_FILL_OUTSIDE_SQL = "select l_orderkey, l_linenumber, coalesce(nullif(cast(l_linenumber as bigint), 3), 3000000000) as x from lineitem"


def v_duplicate_rows(spark, d):
    """DUPLICATE_CHECK over whole rows: all columns of lineitem, the first lines a second time."""
    rows = table(spark, d, "lineitem")
    both = rows.unionByName(rows.where("l_linenumber = 1"))
    return _violations(both, [V("DUPLICATE_CHECK")], LINE_KEY)


_LINE_COLUMNS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
V_DUPLICATE_ROWS_SQL = ("with b as (select * from lineitem union all select * from lineitem where l_linenumber = 1), "
                        f"p as (select *, count(*) over (partition by {_LINE_COLUMNS}) as n from b) "
                        + _viol_sql("p", "l_orderkey, l_linenumber", "n > 1", None, "DUPLICATE_CHECK", {}))


# ======================================================================= A, R, I
def _orders_job(spark, d, name, rules, **kw):
    return JobSpec(name=name, source=SourceSpec(kind="parquet", path=f"{d}/orders.parquet"), target=_target(spark, f"{name}_target"),
                   rules=rules, row_key=("o_orderkey",), load_strategy=kw.pop("load_strategy", "FULL_LOAD"), **kw)


def a_stop_run(spark, d):
    """STOP in a run: the target keeps its rows, the violations are stored, the record counts them."""
    store = RunStore(spark, scratch_path(spark, "a_stop_run_store"))
    spec = _orders_job(spark, d, "a_stop_run", (V("RANGE", "o_totalprice", {"max": 400000}, "STOP"),))
    write_frame(spark, table(spark, d, "customer").select("c_custkey"), spec.target, "FULL_LOAD")
    res = run_job(spark, spec, store, raise_on_error=False)
    return spark.read.parquet(spec.target.path).agg(
        F.count("*").alias("target_rows"), F.lit(res.status).alias("status"), F.lit(res.rejected_count).cast("long").alias("rejected_count"),
        F.lit(store.violations_of(res.run_id).count()).cast("long").alias("stored"))


A_STOP_RUN_SQL = """select (select count(*) from customer) as target_rows, 'FAILED' as status,
count_if(o_totalprice > 400000)::bigint as rejected_count, count_if(o_totalprice > 400000)::bigint as stored from orders"""


def a_row_index_run(spark, d):
    """Counts of a run whose violations carry row numbers."""
    store = RunStore(spark, scratch_path(spark, "a_row_index_run_store"))
    run_job(spark, _orders_job(spark, d, "a_row_index_run", (V("RANGE", "o_totalprice", {"max": 400000}),), row_index=True), store)
    return store.runs().select("source_count", "success_count", "rejected_count")


A_ROW_INDEX_RUN_SQL = """select count(*) as source_count, count_if(o_totalprice <= 400000)::bigint as success_count,
count_if(o_totalprice > 400000)::bigint as rejected_count from orders"""


def a_two_jobs_violations(spark, d):
    """Two jobs in one store whose rows differ in a column's type."""
    store = RunStore(spark, scratch_path(spark, "a_two_jobs_store"))
    for name, kind in (("as_number", "double"), ("as_text", "string")):
        source = scratch_path(spark, "a_two_jobs_source")
        table(spark, d, "orders").selectExpr("o_orderkey", f"cast(o_totalprice as {kind}) as price", "o_custkey").write.parquet(source)
        run_job(spark, JobSpec(name=name, source=SourceSpec(kind="parquet", path=source), target=_target(spark, f"a_two_jobs_{name}"),
                               rules=(V("RANGE", "o_custkey", {"max": 100}),), row_key=("o_orderkey",), load_strategy="FULL_LOAD"), store)
    return store.violations().select("pipeline_id", "o_orderkey", "error_column", "error_rule")


A_TWO_JOBS_SQL = """select p as pipeline_id, o_orderkey, 'o_custkey' as error_column, 'RANGE' as error_rule
from orders, (values ('as_number'), ('as_text')) v(p) where o_custkey > 100"""


def a_unknown_action(spark, d):
    """A run with an action that does not exist is refused; its target is not made."""
    spec = _orders_job(spark, d, "a_unknown_action", (V("NOT_NULL", "o_orderkey", {}, "EXPLODE"),))
    res = run_job(spark, spec, RunStore(spark, scratch_path(spark, "a_unknown_action_store")), raise_on_error=False)
    missing = read_target(spark, spec.target) is None
    return table(spark, d, "orders").agg(F.lit(res.error_code).alias("code"), F.lit(missing).alias("target_missing"), F.count("*").alias("n"))


A_UNKNOWN_ACTION_SQL = "select 'SPEC_INVALID' as code, true as target_missing, count(*) as n from orders"


def r_rejected_run(spark, d):
    """Violations of one run of two in a store."""
    store = RunStore(spark, scratch_path(spark, "r_rejected_run_store"))
    run_job(spark, _orders_job(spark, d, "r_rejected_run", (V("RANGE", "o_totalprice", {"max": 300000}),)), store)
    res = run_job(spark, _orders_job(spark, d, "r_rejected_run", (V("RANGE", "o_totalprice", {"min": 5000}),)), store)
    page = history.rejected_of_run(store.violations_of(res.run_id), res.run_id, limit=100, order_cols=("o_orderkey",))
    return page.select("o_orderkey", "error_column", "error_rule")


R_REJECTED_RUN_SQL = """select o_orderkey, 'o_totalprice' as error_column, 'RANGE' as error_rule
from orders where o_totalprice < 5000 order by o_orderkey limit 100"""


def r_run_log(spark, d):
    """The step log of one run of two, in order."""
    store = RunStore(spark, scratch_path(spark, "r_run_log_store"))
    rules = (V("RANGE", "o_totalprice", {"max": 400000}),)
    run_job(spark, _orders_job(spark, d, "r_run_log", ()), store)
    res = run_job(spark, _orders_job(spark, d, "r_run_log", rules), store)
    return history.run_log(store.logs(), res.run_id, order_cols=("seq",)).select("seq", "level", "stage")


R_RUN_LOG_SQL = """select (row_number() over () - 1)::int as seq, case when stage = 'VALIDATION_DONE' and n = 1 then 'WARN' else 'INFO' end as level, stage
from (select unnest(['METADATA', 'SOURCE_CONNECT', 'TARGET_CONNECT', 'SOURCE_READ_START', 'SOURCE_CONNECTED', 'VALIDATION_START', 'SOURCE_READ_DONE',
  'VALIDATION_DONE', 'VALIDATION_DONE', 'TARGET_WRITE_START', 'TARGET_CONNECTED', 'TARGET_WRITE_DONE', 'JOB_SUCCESS']) as stage,
  unnest([0, 0, 0, 0, 0, 0, 0, 1, 2, 0, 0, 0, 0]) as n)
where stage <> 'VALIDATION_DONE' or n = 2 or (select count_if(o_totalprice > 400000) from orders) > 0"""


def i_stream_restart(spark, d):
    """A job's stream started twice over the same files loads each row once."""
    store = RunStore(spark, scratch_path(spark, "i_stream_restart_store"))
    events = table(spark, d, "events")
    spec = JobSpec(name="i_stream_restart", source=SourceSpec(kind="parquet", path=f"{d}/events.parquet"), target=_target(spark, "i_stream_restart"), load_strategy="APPEND")
    source = scratch_path(spark, "i_stream_restart_source")
    events.write.parquet(source)
    for _ in range(2):
        start_stream(spark, spec, source, events.schema, store=store).awaitTermination()
    return spark.read.parquet(spec.target.path).select("event_id", "user_id", "value")


I_STREAM_RESTART_SQL = "select event_id, user_id, value from events"


def i_mark_instant(spark, d):
    """The mark of an instant column is the text of its maximum in the session's zone, whatever the host's."""
    source = scratch_path(spark, "i_mark_instant_source")
    table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).write.parquet(source)
    store = RunStore(spark, scratch_path(spark, "i_mark_instant_store"))
    spec = JobSpec(name="i_mark_instant", source=SourceSpec(kind="parquet", path=source, checkpoint_col="ts"),
                   target=_target(spark, "i_mark_instant"), load_strategy="INCREMENTAL")
    runs = [run_job(spark, spec, store).success_count for _ in range(2)]
    mark = store.marks().select(F.col("checkpoint_value").cast("timestamp_ntz").alias("mark"))
    return mark.select("mark", F.lit(runs[0]).cast("long").alias("first_run"), F.lit(runs[1]).cast("long").alias("second_run"))


I_MARK_INSTANT_SQL = "select max(ts)::timestamp as mark, count(*) as first_run, 0::bigint as second_run from events"

QUERIES = {
    "l_upsert_null_partition": (l_upsert_null_partition, _upsert_sql(NULL_P)),
    "l_upsert_text_partition": (l_upsert_text_partition, _upsert_sql(TEXT_P)),
    "l_upsert_first_load": (l_upsert_first_load, L_UPSERT_FIRST_LOAD_SQL),
    "l_upsert_narrow_target": (l_upsert_narrow_target, _REFUSED_SQL),
    "l_append_type_conflict": (l_append_type_conflict, _REFUSED_SQL),
    "l_missing_target": (l_missing_target, L_MISSING_TARGET_SQL),
    "l_csv_upsert_text": (l_csv_upsert_text, L_CSV_UPSERT_TEXT_SQL),
    "s_csv_quoted": (s_csv_quoted, S_CSV_QUOTED_SQL),
    "s_csv_big_ints": (s_csv_big_ints, S_CSV_BIG_INTS_SQL),
    "s_list_tables": (s_list_tables, S_LIST_TABLES_SQL),
    "v_range_fraction_on_int": (v_range_fraction_on_int, V_RANGE_FRACTION_SQL),
    "v_range_outside_type": (v_range_outside_type, V_RANGE_OUTSIDE_SQL),
    "v_range_decimal": (v_range_decimal, V_RANGE_DECIMAL_SQL),
    "v_duplicate_rows": (v_duplicate_rows, V_DUPLICATE_ROWS_SQL),
    "t_fill_outside_type": (t_fill_outside_type, T_FILL_OUTSIDE_SQL),
    "a_stop_run": (a_stop_run, A_STOP_RUN_SQL),
    "a_row_index_run": (a_row_index_run, A_ROW_INDEX_RUN_SQL),
    "a_two_jobs_violations": (a_two_jobs_violations, A_TWO_JOBS_SQL),
    "a_unknown_action": (a_unknown_action, A_UNKNOWN_ACTION_SQL),
    "r_rejected_run": (r_rejected_run, R_REJECTED_RUN_SQL),
    "r_run_log": (r_run_log, R_RUN_LOG_SQL),
    "i_stream_restart": (i_stream_restart, I_STREAM_RESTART_SQL),
    "i_mark_instant": (i_mark_instant, I_MARK_INSTANT_SQL),
}
