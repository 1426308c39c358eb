import pytest

from tidewater.errors import JobError
from tidewater.session import scratch_path
from tidewater.sources.readers import describe, jdbc_options, preview, read_csv, read_source
from tidewater.spec import SourceSpec


def test_csv_null_tokens_and_inference(spark):
    p = scratch_path(spark, "csv")
    rows = [("1", "NULL", "2.5", "true", "x"), ("2", "N/A", "", "false", "NA"), ("null", "b", "3", "TRUE", "")]
    spark.createDataFrame(rows, "a string, b string, c string, d string, e string").coalesce(1) \
        .write.option("header", "true").csv(p)
    df = read_csv(spark, p)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "string", "double", "boolean", "string"]
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted([(1, None, 2.5, True, "x"), (2, None, None, False, None), (None, "b", 3.0, True, None)], key=repr)


def test_incremental_predicate_pushed(spark, sf_small):
    src = SourceSpec(kind="parquet", path=f"{sf_small}/events.parquet", checkpoint_col="ts")
    df = read_source(spark, src, checkpoint_value="2024-01-20 00:00:00")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "ts" in plan
    assert df.where("ts <= timestamp_ntz'2024-01-20 00:00:00'").count() == 0


def test_unknown_kind(spark):
    with pytest.raises(JobError):
        read_source(spark, SourceSpec(kind="excel", path="x"))


def test_preview_cap_and_describe(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/orders.parquet")
    assert preview(df, 1000, ["o_orderkey"]).count() == 100
    assert preview(df).count() == 20
    d = {r.name: r.data_type for r in describe(spark, df).collect()}
    assert d["o_orderkey"] == "BIGINT" and d["o_orderdate"] == "TIMESTAMP" and d["o_orderstatus"] == "VARCHAR"


def test_jdbc_options():
    o = jdbc_options("jdbc:postgresql://h/db", table="t", schema="public", partition_column="id",
                     lower_bound=0, upper_bound=100, num_partitions=4)
    assert o["dbtable"] == "public.t" and o["numPartitions"] == "4"
    assert jdbc_options("jdbc:x", query="select 1")["query"] == "select 1"
    with pytest.raises(JobError):
        jdbc_options("jdbc:x", query="select 1", partition_column="id", lower_bound=0, upper_bound=1, num_partitions=2)


@pytest.mark.parametrize("kind", ["orc", "json", "parquet"])
def test_file_kinds_roundtrip(spark, sf_small, kind):
    from tidewater.sources.sinks import write_frame
    from tidewater.spec import TargetSpec
    src = spark.read.parquet(f"{sf_small}/nation.parquet")
    t = TargetSpec(kind=kind, path=scratch_path(spark, f"rt_{kind}"))
    write_frame(spark, src, t, "FULL_LOAD")
    back = read_source(spark, SourceSpec(kind=kind, path=t.path))
    assert back.count() == src.count()
    assert sorted(r.n_name for r in back.collect()) == sorted(r.n_name for r in src.collect())


def test_list_tables(spark, sf_small):
    from tidewater.sources.readers import list_tables
    spark.read.parquet(f"{sf_small}/region.parquet").createOrReplaceTempView("tw_region_lt")
    names = [r.name for r in list_tables(spark).collect()]
    assert "tw_region_lt" in names and names == sorted(names)


def test_jdbc_batchsize_from_spec():
    from tidewater.sources.sinks import _jdbc_options
    from tidewater.spec import TargetSpec
    o = _jdbc_options(TargetSpec(kind="jdbc", table="t", options={"url": "jdbc:x"}), 10000)
    assert o["batchsize"] == "10000" and o["dbtable"] == "t"


def test_turkish_charset_csv(spark):
    import os
    from tidewater.session import local_path
    p = scratch_path(spark, "tr_csv")
    os.makedirs(local_path(p))
    with open(os.path.join(local_path(p), "part.csv"), "w", encoding="iso-8859-9") as f:
        f.write("id;name\n1;İğdır Şişe\n2;NULL\n")
    df = read_csv(spark, p, sep=";", encoding="ISO-8859-9")
    assert sorted((r.id, r.name) for r in df.collect()) == [(1, "İğdır Şişe"), (2, None)]


def test_describe_table_missing(spark):
    from tidewater.sources.readers import describe_table
    with pytest.raises(JobError) as e:
        describe_table(spark, "no_such_table_xyz")
    assert e.value.code == "TABLE_NOT_FOUND"


def test_preview_payload(spark, sf_small):
    from tidewater.sources.readers import preview_payload
    p = preview_payload(spark.read.parquet(f"{sf_small}/region.parquet"), 3, ["r_regionkey"])
    assert p["count"] == 3 and p["columns"] == ["r_regionkey", "r_name"] and p["rows"][0]["r_regionkey"] == 0


def test_jdbc_bounds_query():
    from tidewater.sources.readers import bounds_query
    assert bounds_query('"s"."t"', "id") == 'select min(id) as lo, max(id) as hi from "s"."t"'


def test_incremental_partition_pruning_and_lookback(spark, sf_small):
    from pyspark.sql import functions as F
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    p = scratch_path(spark, "ev_part")
    ev.withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(p)
    mark = "2024-01-20 12:00:00"
    src = SourceSpec(kind="parquet", path=p, checkpoint_col="ts", options={"mark_partition_column": "dt"})
    df = read_source(spark, src, checkpoint_value=mark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "dt#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert df.count() == ev.where(F.col("ts") > mark).count()
    back = SourceSpec(kind="parquet", path=p, checkpoint_col="ts",
                      options={"mark_partition_column": "dt", "lookback": "1 DAY"})
    assert read_source(spark, back, checkpoint_value=mark).count() == \
        ev.where(F.col("ts") > "2024-01-19 12:00:00").count()


def test_jdbc_without_driver_is_a_connection_failure(spark):
    src = SourceSpec(kind="jdbc", table="t", options={"url": "jdbc:nosuchdb://localhost:1/x"})
    with pytest.raises(JobError) as e:
        read_source(spark, src)
    assert e.value.code == "SOURCE_CONNECTION_FAILED"
