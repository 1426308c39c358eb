"""Driver queries for loads that are interrupted, repeated or given rows that do not fit, and for targets and histories that
grow: whole tables, a DuckDB SQL each."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.errors import JobError
from tidewater.operators import history
from tidewater.operators.drift import as_struct
from tidewater.plans.catalog_core import M, V, table
from tidewater.plans.catalog_flow import _target
from tidewater.plans.runner import run_job
from tidewater.plans.store import LOG_STRUCT, RunStore
from tidewater.session import scratch_path
from tidewater.sources import publish
from tidewater.sources.readers import read_source
from tidewater.sources.sinks import compact_target, read_target, write_frame
from tidewater.spec import JobSpec, SourceSpec
from tidewater.streaming.scheduled import UniqueAcross, start_stream


class _LostStore(RunStore):
    """A run store whose writer is lost before the run's record."""

    def append_run(self, record, logs):
        raise publish.DriverLost("record")


def _store(spark, name) -> RunStore:
    return RunStore(spark, scratch_path(spark, f"{name}_store"))


# ======================================================================= L
def l_upsert_touched_files(spark, d):
    """Lines of a few orders change: only the files that hold them are rewritten; all rows are as after a full merge."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_extendedprice").alias("l_extendedprice"))
    t = _target(spark, "l_upsert_touched_files")
    write_frame(spark, lines.repartitionByRange(16, "l_orderkey"), t, "FULL_LOAD")
    before = set(publish.data_files(spark, t.path))
    top = lines.agg(F.max("l_orderkey").alias("m")).first()["m"]
    few = lines.where(F.col("l_orderkey") > F.lit(top) - 50)
    change = few.select("l_orderkey", "l_linenumber", (-F.col("l_quantity")).alias("l_quantity"))
    change = change.unionByName(few.select((F.col("l_orderkey") + top).alias("l_orderkey"), "l_linenumber", "l_quantity"))
    got = write_frame(spark, change, t, "UPSERT", ("l_orderkey", "l_linenumber"))
    kept = before & set(publish.data_files(spark, t.path))
    few_files = got.files_replaced <= 4 and len(kept) == len(before) - got.files_replaced and len(before) >= 12
    return read_target(spark, t).select("l_orderkey", "l_linenumber", F.round("l_quantity", 2).alias("l_quantity"), F.round("l_extendedprice", 2).alias("l_extendedprice"),
                                        F.lit(few_files).alias("other_files_untouched"))


L_UPSERT_TOUCHED_FILES_SQL = """
with l as (select l_orderkey, l_linenumber, max(l_quantity) as q, max(l_extendedprice) as p from lineitem group by all),
few as (select * from l where l_orderkey > (select max(l_orderkey) from lineitem) - 50),
s as (select l_orderkey, l_linenumber, -q as q from few
      union all select l_orderkey + (select max(l_orderkey) from lineitem), l_linenumber, q from few)
select coalesce(s.l_orderkey, l.l_orderkey) as l_orderkey, coalesce(s.l_linenumber, l.l_linenumber) as l_linenumber,
       round(coalesce(s.q, l.q), 2) as l_quantity, round(l.p, 2) as l_extendedprice, true as other_files_untouched
from l full join s on l.l_orderkey = s.l_orderkey and l.l_linenumber = s.l_linenumber"""


def l_compact_files(spark, d):
    """Small files of a target, partitioned and not, become few in one commit; a compaction that is lost changes nothing that a reader sees."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    out = []
    for by in ((), ("o_orderstatus",)):
        t = _target(spark, f"l_compact_files_{len(by)}", partition_by=by)
        for k in range(4):
            write_frame(spark, o.where(F.col("o_orderkey") % 4 == k).repartition(3), t, "APPEND")
        before = len(publish.data_files(spark, t.path))
        try:
            with publish.lost_at("moving"):
                compact_target(spark, t)
        except publish.DriverLost:
            pass
        seen = read_target(spark, t).count()
        replaced = compact_target(spark, t) or before  # settles the lost one first
        few = len(publish.data_files(spark, t.path)) <= 3 and replaced == before
        out.append(spark.read.parquet(t.path).select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(len(by)).alias("columns"), F.lit(few).alias("few"), F.lit(seen).alias("seen")))
    return out[0].unionByName(out[1])


L_COMPACT_FILES_SQL = """
select o_orderkey, o_custkey, o_orderstatus, k as columns, true as few, (select count(*) from orders) as seen from orders, (values (0), (1)) v(k)"""


def l_publish_crash(spark, d):
    """A replacement is lost at each of its steps: what a reader sees then, and after the next writer has come."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    out = []
    for strategy in ("FULL_LOAD", "OVERWRITE", "UPSERT", "APPEND"):
        for step in publish.STEPS:
            t = _target(spark, f"l_publish_crash_{step}")
            write_frame(spark, o, t, "FULL_LOAD")
            change = o.where("o_orderkey % 4 = 0").select((F.col("o_orderkey") + (0 if strategy == "UPSERT" else 10 ** 9)).alias("o_orderkey"), F.lit(-1).cast("bigint").alias("o_custkey"))
            try:
                with publish.lost_at(step):
                    write_frame(spark, change, t, strategy, ("o_orderkey",))
                raise AssertionError("the load was not lost")
            except publish.DriverLost:
                pass
            counts = [F.count("*").alias("n"), F.count_if(F.col("o_custkey") == -1).alias("changed")]
            seen = read_target(spark, t).agg(*counts).first()
            write_frame(spark, spark.createDataFrame([], o.schema), t, "APPEND")
            after = spark.read.parquet(t.path).agg(F.lit(strategy).alias("strategy"), F.lit(step).alias("step"), F.lit(seen.n).alias("seen"), F.lit(seen.changed).alias("seen_changed"), *counts)
            out.append(after)
    return reduce(DataFrame.unionByName, out)


L_PUBLISH_CRASH_SQL = """
with c as (select count(*) as a, count_if(o_orderkey % 4 = 0) as b from orders),
x as (select * from (values ('FULL_LOAD'), ('OVERWRITE'), ('UPSERT'), ('APPEND')) s(strategy), (values ('staged', 0), ('committed', 1), ('moving', 1), ('moved', 1)) p(step, new)),
r as (select strategy, step, case when new = 0 then a when strategy = 'UPSERT' then a when strategy = 'APPEND' then a + b else b end as n,
             case when new = 0 then 0 else b end as k from x, c)
select strategy, step, n as seen, k::bigint as seen_changed, n, k::bigint as changed from r"""


# ======================================================================= I
def i_crash_retry(spark, d):
    """Incremental runs lost between the load and its record, twice in a row: the next ones go on behind what is loaded."""
    events = table(spark, d, "events").select("event_id", "ts", "value")
    source = scratch_path(spark, "i_crash_retry_source")
    spec = JobSpec(name="i_crash_retry", source=SourceSpec(kind="parquet", path=source, checkpoint_col="ts"), target=_target(spark, "i_crash_retry"),
                   rules=(V("RANGE", "value", {"max": 400}),), load_strategy="INCREMENTAL")
    store = _store(spark, "i_crash_retry")
    slices = (("2000-01-01", "2024-01-08", True), ("2024-01-08", "2024-01-15", True), ("2024-01-15", "2024-01-22", False), ("2024-01-22", "2100-01-01", False))
    for low, high, lost in slices:
        events.where((F.col("ts") >= low) & (F.col("ts") < high)).write.mode("append").parquet(source)
        try:
            run_job(spark, spec, _LostStore(spark, store.base) if lost else store)
        except publish.DriverLost:
            pass
    run_job(spark, spec, store)  # nothing new
    return spark.read.parquet(spec.target.path).select("event_id", "value")


I_CRASH_RETRY_SQL = "select event_id, value from events where value <= 400"


def i_append_retry(spark, d):
    """An appending run that its caller repeats under the same id: the rows are loaded once, the record is made up for."""
    spec = JobSpec(name="i_append_retry", source=SourceSpec(kind="parquet", path=f"{d}/orders.parquet"), target=_target(spark, "i_append_retry"), load_strategy="APPEND")
    store, run = _store(spark, "i_append_retry"), uuid.uuid4().hex
    try:
        run_job(spark, spec, _LostStore(spark, store.base), run_id=run)
    except publish.DriverLost:
        pass
    again = run_job(spark, spec, store, run_id=run)
    return spark.read.parquet(spec.target.path).select("o_orderkey", "o_custkey", F.lit(again.success_count).alias("recorded"), F.lit(again.status).alias("status"))


I_APPEND_RETRY_SQL = "select o_orderkey, o_custkey, (select count(*) from orders) as recorded, 'SUCCESS' as status from orders"


def i_stream_unique(spark, d):
    """A key that occurs in several files: only values that occur once in their batch and in no earlier one are loaded.

    The first file holds the even events, the second the odd ones; keys repeat after an odd number of events, so that most are met again
    in the other file.  The third file has keys of both, and new ones."""
    events = table(spark, d, "events").select("event_id", "ts")
    top = events.agg(F.max("event_id").alias("m")).first()["m"]
    events = events.withColumn("k", F.col("event_id") % F.lit((top * 3 // 5) | 1))
    source = scratch_path(spark, "i_stream_unique_source")
    store = _store(spark, "i_stream_unique")
    spec = JobSpec(name="i_stream_unique", source=SourceSpec(kind="parquet", path=source), target=_target(spark, "i_stream_unique"),
                   load_strategy="APPEND", rules=(V("UNIQUE", "k"),))
    third = events.where("event_id % 10 = 0").withColumn("k", F.col("k") + F.when(F.col("event_id") % 20 == 0, F.lit(10 * top)).otherwise(F.lit(0)))
    for p in (events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), third):
        p.coalesce(1).write.mode("append").parquet(source)
        start_stream(spark, spec, source, events.schema, store=store, unique=UniqueAcross("k")).awaitTermination()
    bad = store.violations().agg(F.count("*").alias("n")).first()["n"]
    return spark.read.parquet(spec.target.path).select("event_id", "k", F.lit(bad).alias("violations"))


I_STREAM_UNIQUE_SQL = """
with t as (select max(event_id) as top, (max(event_id) * 3 // 5) | 1 as m from events),
e as (select event_id, event_id % m as k, top from events, t),
p as (select event_id, k, 0 as b from e where event_id % 2 = 0
      union all select event_id, k, 1 from e where event_id % 2 = 1
      union all select event_id, k + case when event_id % 20 = 0 then 10 * top else 0 end, 2 from e where event_id % 10 = 0),
f as (select *, count(*) over (partition by k, b) > 1 or min(b) over (partition by k) < b as bad from p)
select event_id, k, (select count_if(bad) from f) as violations from f where not bad"""


def i_stream_late(spark, d):
    """Keys are remembered for two days behind the latest event: older rows are late and counted, older keys may come again."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    source = scratch_path(spark, "i_stream_late_source")
    store = _store(spark, "i_stream_late")
    spec = JobSpec(name="i_stream_late", source=SourceSpec(kind="parquet", path=source), target=_target(spark, "i_stream_late"),
                   load_strategy="APPEND", rules=(V("UNIQUE", "event_id"),), row_key=("event_id",))
    first = events.where("event_id % 2 = 0")
    second = events.where("event_id % 2 = 1").unionByName(events.where("event_id % 6 = 0"))
    for p in (first, second):
        p.coalesce(1).write.mode("append").parquet(source)
        start_stream(spark, spec, source, events.schema, store=store, unique=UniqueAcross("event_id", "ts", "2 days")).awaitTermination()
    return store.violations().select("event_id", "error_rule")


I_STREAM_LATE_SQL = """
with f as (select * from events where event_id % 2 = 0), m as (select max(ts) - interval 2 day as low from f),
s as (select event_id, ts from events where event_id % 2 = 1 or event_id % 6 = 0)
select event_id, 'RANGE' as error_rule from s, m where ts < low
union all select event_id, 'UNIQUE' from s, m where event_id % 2 = 0 and ts >= low"""


# ======================================================================= S
_BAD_CSV = """select case when o_orderkey % 11 = 1 then concat(o_orderkey, ',short')
  when o_orderkey % 11 = 2 then concat(o_orderkey, ',1,2,3,4,5')
  when o_orderkey % 11 = 3 then concat('99999999999999999999,', o_custkey, ',', round(o_totalprice, 2), ',x')
  when o_orderkey % 11 = 4 then concat(o_orderkey, ',abc,', round(o_totalprice, 2), ',x')
  when o_orderkey % 11 = 5 then concat(o_orderkey, ',', o_custkey, ',NULL,"two ""quoted"" words, one comma"')
  else concat(o_orderkey, ',', o_custkey, ',', round(o_totalprice, 2), ',', o_orderpriority) end as value from o"""
_BAD_SCHEMA = "k bigint, c bigint, price double, note string"


def _bad_csv(spark, d, name):
    """A folder of CSV files in which four of eleven rows do not parse."""
    table(spark, d, "orders").createOrReplaceTempView("o")
    path = scratch_path(spark, name)
    rows = spark.sql(_BAD_CSV)
    header = spark.sql("select 'k,c,price,note' as value")
    for k in range(2):
        part = rows.where(F.pmod(F.xxhash64("value"), F.lit(2)) == k).coalesce(1)
        header.coalesce(1).union(part).coalesce(1).write.mode("append").text(path)
    return path


def s_csv_quarantine(spark, d):
    """Rows that do not parse become violations with a reason, the others load: both, beside each other."""
    path = _bad_csv(spark, d, "s_csv_quarantine_source")
    store = _store(spark, "s_csv_quarantine")
    spec = JobSpec(name="s_csv_quarantine", source=SourceSpec(kind="csv", path=path, options={"schema": _BAD_SCHEMA, "bad_rows": "quarantine"}),
                   target=_target(spark, "s_csv_quarantine"), rules=(V("RANGE", "price", {"max": 300000}),), load_strategy="FULL_LOAD")
    res = run_job(spark, spec, store)
    counts = F.concat_ws("/", F.lit(res.source_count), F.lit(res.success_count), F.lit(res.rejected_rows))
    good = spark.read.parquet(spec.target.path).select(F.col("k").cast("string").alias("k"), F.lit("").alias("rule"), F.col("c").cast("string").alias("c"), "note")
    bad = store.violations().where("error_rule <> 'RANGE'")
    line = F.get_json_object("source_data", "$.line") if dict(bad.dtypes)["source_data"] == "string" else F.col("source_data.line")
    bad = bad.select(F.split(line, ",")[0].alias("k"), F.col("error_rule").alias("rule"), F.col("error_column").alias("c"), F.lit(None).cast("string").alias("note"))
    return good.unionByName(bad).withColumn("counts", counts)


S_CSV_QUARANTINE_SQL = """
with r as (select o_orderkey % 11 as m, round(o_totalprice, 2) as p, * from orders),
a as (select case when m = 3 then '99999999999999999999' else o_orderkey::varchar end as k,
             case when m in (1, 2) then 'CSV_FORMAT' when m in (3, 4) then 'CSV_TYPE' else '' end as rule,
             case when m in (1, 2) then '' when m = 3 then 'k' when m = 4 then 'c' else o_custkey::varchar end as c,
             case when m between 1 and 4 then null when m = 5 then 'two "quoted" words, one comma' else o_orderpriority end as note,
             not (m between 1 and 5) and p > 300000 as high, m between 1 and 4 as bad from r),
n as (select concat_ws('/', count(*), count_if(not bad and not high), count_if(bad or high)) as counts from a)
select k, rule, c, note, counts from a, n where not high"""


def i_stream_csv(spark, d):
    """A stream of CSV files: quoted line breaks, null tokens, and rows that do not parse, kept as violations."""
    o = table(spark, d, "orders")
    lines = o.select(F.concat_ws(",", "o_orderkey", F.when(F.col("o_orderkey") % 7 == 3, F.lit("abc")).when(F.col("o_orderkey") % 7 == 4, F.lit("N/A")).otherwise(F.col("o_custkey").cast("string")),
                                 F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit('"a'), F.lit("\n"), F.lit('b"'))).when(F.col("o_orderkey") % 5 == 1, F.lit("x,EXTRA")).otherwise(F.col("o_orderpriority"))).alias("value"))
    source, store = scratch_path(spark, "i_stream_csv_source"), _store(spark, "i_stream_csv")
    header = spark.sql("select 'k,c,note' as value")
    for part in (lines.where(F.col("value").contains("\n")), lines.where(~F.col("value").contains("\n"))):
        header.coalesce(1).union(part.coalesce(1)).coalesce(1).write.mode("append").text(source)
    spec = JobSpec(name="i_stream_csv", source=SourceSpec(kind="csv", path=source, options={"bad_rows": "quarantine"}), target=_target(spark, "i_stream_csv"), load_strategy="APPEND")
    start_stream(spark, spec, source, "k bigint, c int, note string", fmt="csv", store=store, max_files_per_trigger=1).awaitTermination()
    bad = {r["error_rule"]: r["n"] for r in store.violations().groupBy("error_rule").agg(F.count("*").alias("n")).collect()}
    return spark.read.parquet(spec.target.path).select("k", F.col("c").cast("bigint").alias("c"), "note", F.lit(bad.get("CSV_FORMAT", 0)).cast("bigint").alias("bad_width"),
                                                       F.lit(bad.get("CSV_TYPE", 0)).cast("bigint").alias("bad_value"))


I_STREAM_CSV_SQL = """
with r as (select o_orderkey as k, o_custkey as c, o_orderkey % 7 as a, o_orderkey % 5 as b, o_orderpriority as p from orders),
n as (select count_if(b = 1) as w, count_if(b <> 1 and a = 3) as v from r)
select k, case when a = 4 then null else c end as c, case when b = 0 then 'a' || chr(10) || 'b' else p end as note, w as bad_width, v as bad_value
from r, n where b <> 1 and a <> 3"""


def s_csv_misfit(spark, d):
    """A value outside the given type fails the run of a strict CSV source; nothing is loaded."""
    table(spark, d, "orders").createOrReplaceTempView("o")
    path = scratch_path(spark, "s_csv_misfit_source")
    spark.sql("select 'k,c' as value").coalesce(1).union(spark.sql("select concat(o_orderkey, ',', case when o_orderkey % 100 = 7 then 'abc' else cast(o_custkey as string) end) as value from o").coalesce(1)).coalesce(1).write.text(path)
    spec = JobSpec(name="s_csv_misfit", source=SourceSpec(kind="csv", path=path, options={"schema": "k bigint, c int"}), target=_target(spark, "s_csv_misfit"), load_strategy="FULL_LOAD")
    res = run_job(spark, spec, _store(spark, "s_csv_misfit"), raise_on_error=False)
    loose = read_source(spark, SourceSpec(kind="csv", path=path, options={"schema": "k bigint, c string"}))
    return loose.agg(F.lit(res.status).alias("status"), F.lit(read_target(spark, spec.target) is None).alias("no_target"), F.count("*").alias("n"), F.count_if(F.col("c") == "abc").alias("misfits"))


S_CSV_MISFIT_SQL = "select 'FAILED' as status, true as no_target, count(*) as n, count_if(o_orderkey % 100 = 7) as misfits from orders"


# ======================================================================= E / D
def e_pinned_source(spark, d):
    """A cut without an order, whose rows differ from one reading to the next: rows read = rows loaded + rows rejected."""
    spark.read.parquet(f"{d}/lineitem.parquet").createOrReplaceTempView("pinned_lines")
    query = "select l_orderkey, l_linenumber, cast(rand() * 100 as int) as draw from pinned_lines limit 500000"
    store = _store(spark, "e_pinned_source")
    spec = JobSpec(name="e_pinned_source", source=SourceSpec(kind="sql", query=query), target=_target(spark, "e_pinned_source"), rules=(V("RANGE", "draw", {"max": 49}),), load_strategy="FULL_LOAD")
    res = run_job(spark, spec, store)
    loaded = spark.read.parquet(spec.target.path)
    rejected = store.violations().select("source_data.*")
    both = loaded.withColumn("side", F.lit(1)).unionByName(rejected.withColumn("side", F.lit(2)))
    return both.agg(F.count("*").alias("n"), F.lit(res.source_count).alias("source_count"), (F.lit(res.success_count) + F.lit(res.rejected_rows)).cast("bigint").alias("parts"),
                    F.count_if((F.col("draw") > 49) != (F.col("side") == 2)).alias("misplaced"))


E_PINNED_SOURCE_SQL = """
with c as (select least(count(*), 500000) as n from lineitem) select n, n as source_count, n as parts, 0::bigint as misplaced from c"""


def d_drift_stop_run(spark, d):
    """NULLs where none are expected stop a run before its load, with rules and without; WARN loads and says so."""
    source = scratch_path(spark, "d_drift_stop_run_source")
    table(spark, d, "orders").selectExpr("o_orderkey", "case when o_orderkey % 3 = 0 then null else o_custkey end as o_custkey").write.parquet(source)
    expected = as_struct("o_orderkey bigint, o_custkey bigint not null")
    out = []
    for action in ("STOP", "WARN"):
        for rules in ((), (V("RANGE", "o_orderkey", {"min": 0}),)):
            name = f"d_drift_{action}_{len(rules)}"
            store, target = _store(spark, name), _target(spark, name)
            spec = JobSpec(name=name, source=SourceSpec(kind="parquet", path=source), target=target, rules=rules, expected_schema=expected, schema_drift_action=action, load_strategy="FULL_LOAD")
            res = run_job(spark, spec, store, raise_on_error=False)
            rows = read_target(spark, target)
            texts = store.logs().where("stage = 'SCHEMA_DRIFT'").count()
            n = 0 if rows is None else rows.count()
            out.append((action, len(rules), res.status, res.error_code, n, texts))
    return spark.createDataFrame(out, "action string, rules int, status string, code string, loaded bigint, warnings bigint")


D_DRIFT_STOP_RUN_SQL = """
select 'STOP' as action, r as rules, 'FAILED' as status, 'SCHEMA_DRIFT' as code, 0::bigint as loaded, 0::bigint as warnings from (values (0), (1)) v(r)
union all select 'WARN', r, 'SUCCESS', null, (select count(*) from orders), 1 from (values (0), (1)) v(r)"""


def d_evolve_append(spark, d):
    """Targets that gain a column: by an append, then by a merge that fills it for some older rows."""
    o = table(spark, d, "orders")
    t = _target(spark, "d_evolve_append", evolve="add")
    write_frame(spark, o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey"), t, "FULL_LOAD")
    write_frame(spark, o.where("o_orderkey % 2 = 1").select("o_orderkey", "o_custkey", "o_orderpriority"), t, "APPEND")
    write_frame(spark, o.where("o_orderkey % 6 = 0").select("o_orderkey", F.lit("late").alias("note")), t, "UPSERT", ("o_orderkey",))
    return read_target(spark, t).select("o_orderkey", "o_custkey", "o_orderpriority", "note")


D_EVOLVE_APPEND_SQL = """
select o_orderkey, o_custkey, case when o_orderkey % 2 = 1 then o_orderpriority end as o_orderpriority, case when o_orderkey % 6 = 0 then 'late' end as note from orders"""


# ======================================================================= R / A
def r_mark_snapshot(spark, d):
    """Marks of a history of many runs, part of it in the snapshot and compacted: as a scan of all of it gives them."""
    e = table(spark, d, "events")
    runs = (e.groupBy((F.col("user_id") % 25).alias("j"), F.col("ts").cast("date").alias("day"))
            .agg(F.max("ts").alias("at"), F.count("*").alias("n"), F.max("event_id").alias("m")))
    nulls = {"run_type": "string", "error_count": "bigint", "error_message": "string", "error_detail": "string", "logs": f"array<{LOG_STRUCT}>"}
    records = runs.select(
        F.concat_ws("-", "j", "day").alias("id"), F.concat(F.lit("job"), F.col("j")).alias("pipeline_id"),
        F.when(F.col("n") % 5 == 0, F.lit("FAILED")).otherwise(F.lit("SUCCESS")).alias("status"), F.col("at").alias("started_at"), F.col("at").alias("finished_at"),
        F.lit(1.0).alias("duration_seconds"), *[F.col("n").alias(c) for c in ("source_count", "target_count", "success_count", "rejected_count", "rejected_rows")],
        F.col("at").alias("created_at"), F.lit("event_id").alias("checkpoint_column"),
        F.when(F.col("n") % 3 != 0, F.col("m").cast("string")).alias("checkpoint_value"), *[F.lit(None).cast(t).alias(c) for c, t in nulls.items()])
    store = _store(spark, "r_mark_snapshot")
    for k in range(3):  # several appends, so that days hold several files
        store.append_records(records.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k))
    middle = e.agg(F.expr("date_add(cast(min(ts) as date), cast(datediff(max(ts), min(ts)) / 2 as int))").alias("d")).first()["d"]
    store.compact(before=middle)
    before = publish.data_files(spark, store.path("run_records"))
    store.compact(before=middle)  # nothing is left to do
    same = before == publish.data_files(spark, store.path("run_records"))
    n = store.runs().count()
    return store.marks().select("pipeline_id", "checkpoint_value", F.lit(n).alias("runs"), F.lit(same).alias("settled"))


R_MARK_SNAPSHOT_SQL = """
with r as (select user_id % 25 as j, cast(ts as date) as day, max(ts) as last_ts, count(*) as n, max(event_id) as m from events group by all)
select 'job' || j as pipeline_id, arg_max(m, last_ts)::varchar as checkpoint_value, (select count(*) from r) as runs, true as settled
from r where n % 5 <> 0 and n % 3 <> 0 group by j"""


def r_page_seek(spark, d):
    """All pages of a table, each sought from the last row of the one before; every row once."""
    runs = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").alias("pipeline_id"))
    limit = max(1000, -(-runs.count() // 12))
    token, pages = None, 0
    path = scratch_path(spark, "r_page_seek")
    while True:
        page = history.page_after(runs, token, limit)
        page.withColumn("page", F.lit(pages)).write.mode("append").parquet(path)
        last = spark.read.parquet(path).where(F.col("page") == pages).orderBy("created_at", "id").limit(1).collect()
        if not last:
            break
        token, pages = history.page_token(last[0]), pages + 1
    return spark.read.parquet(path).groupBy("page").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.sum("id").alias("s"), F.countDistinct("id").alias("ids"))


R_PAGE_SEEK_SQL = """
with l as (select greatest(1000, (count(*) + 11) // 12) as k from events),
p as (select event_id as id, ((row_number() over (order by ts desc, event_id desc) - 1) // k)::int as page from events, l)
select page, count(*) as n, min(id) as a, sum(id)::bigint as s, count(distinct id) as ids from p group by page"""


def a_row_index_files(spark, d):
    """Row numbers of violations of a run over Parquet files: files in the order of their names, rows as they stand in them."""
    source = scratch_path(spark, "a_row_index_files_source")
    table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").repartitionByRange(7, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(source)
    store = _store(spark, "a_row_index_files")
    spec = JobSpec(name="a_row_index_files", source=SourceSpec(kind="parquet", path=source), target=_target(spark, "a_row_index_files"), row_key=("o_orderkey",), row_index=True,
                   mappings=(M("price", "o_totalprice", 0),), rules=(V("RANGE", "price", {"max": 300000}),), load_strategy="FULL_LOAD")
    run_job(spark, spec, store)
    return store.violations().select("o_orderkey", "row_number", "error_column")


A_ROW_INDEX_FILES_SQL = """
with p as (select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) - 1 as row_number from orders)
select o_orderkey, row_number, 'price' as error_column from p where o_totalprice > 300000"""


QUERIES = {
    "r_mark_snapshot": (r_mark_snapshot, R_MARK_SNAPSHOT_SQL),
    "r_page_seek": (r_page_seek, R_PAGE_SEEK_SQL),
    "a_row_index_files": (a_row_index_files, A_ROW_INDEX_FILES_SQL),
    "l_upsert_touched_files": (l_upsert_touched_files, L_UPSERT_TOUCHED_FILES_SQL),
    "l_compact_files": (l_compact_files, L_COMPACT_FILES_SQL),
    "l_publish_crash": (l_publish_crash, L_PUBLISH_CRASH_SQL),
    "i_crash_retry": (i_crash_retry, I_CRASH_RETRY_SQL),
    "i_append_retry": (i_append_retry, I_APPEND_RETRY_SQL),
    "i_stream_unique": (i_stream_unique, I_STREAM_UNIQUE_SQL),
    "i_stream_late": (i_stream_late, I_STREAM_LATE_SQL),
    "i_stream_csv": (i_stream_csv, I_STREAM_CSV_SQL),
    "s_csv_quarantine": (s_csv_quarantine, S_CSV_QUARANTINE_SQL),
    "s_csv_misfit": (s_csv_misfit, S_CSV_MISFIT_SQL),
    "e_pinned_source": (e_pinned_source, E_PINNED_SOURCE_SQL),
    "d_drift_stop_run": (d_drift_stop_run, D_DRIFT_STOP_RUN_SQL),
    "d_evolve_append": (d_evolve_append, D_EVOLVE_APPEND_SQL),
}
