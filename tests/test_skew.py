"""One key holding a third of all rows: results stay exact and whole, and the
plans keep the hot key out of a single task (partial aggregation, broadcast of
the measured duplicate set, no window over the key)."""
from pyspark.sql import functions as F

from tidewater.operators.duplicates import flag_duplicates
from tidewater.operators.merge import dedup_last, upsert

N = 300_000


def skewed(spark):
    return spark.range(N).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"),
        (F.col("id") % 1000).alias("v"))


def test_unique_flag_hot_key(spark):
    df = skewed(spark)
    out = flag_duplicates(df, ["k"], "dup", materialize_keys=True)
    # key 7 appears N/3 times (+1 when id 7 itself is not a multiple of 3)
    hot = df.where("k = 7").count()
    assert out.where("dup").count() == hot
    assert out.count() == N
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_dedup_last_hot_key(spark):
    df = skewed(spark)
    best = dedup_last(df, ["k"], "id")
    assert best.count() == df.select("k").distinct().count()
    row = best.where("k = 7").collect()[0]
    assert row.id == df.where("k = 7").agg(F.max("id")).collect()[0][0]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_upsert_hot_key_source(spark):
    tgt = spark.range(1000).select(F.col("id").alias("k"), F.lit("t").alias("v"))
    src = skewed(spark).select("k", F.col("v").cast("string").alias("v"), "id")
    merged = upsert(tgt, src, ["k"], "id")
    assert merged.count() == src.select("k").distinct().union(tgt.select("k")).distinct().count()


def test_unique_flag_shuffled_path_matches(spark):
    from tidewater.operators.duplicates import BROADCAST_LIMIT_CONF
    df = skewed(spark)
    small = flag_duplicates(df, ["k"], "dup", materialize_keys=True)
    spark.conf.set(BROADCAST_LIMIT_CONF, "0")
    try:
        big = flag_duplicates(df, ["k"], "dup", materialize_keys=True)
        plan = big._jdf.queryExecution().executedPlan().toString()
        assert big.where("dup").count() == small.where("dup").count()
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan or "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset(BROADCAST_LIMIT_CONF)


def test_plan_shapes_keep_the_big_side_unshuffled(spark, sf_small):
    """Small measured duplicate sets are broadcast: no hash shuffle anywhere in
    the flag plan.  A small UPSERT source is broadcast: the target is streamed
    through a broadcast left join."""
    from tidewater.operators.merge import upsert
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    flagged = flag_duplicates(docs, ["text"], "dup", materialize_keys=True)
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    orders = spark.read.parquet(f"{sf_small}/orders.parquet")
    src = orders.limit(10).withColumn("o_orderstatus", F.lit("U"))
    merged = upsert(orders, src, ["o_orderkey"], plan="auto")
    mplan = merged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in mplan and "FullOuter" not in mplan
