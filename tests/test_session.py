from tidewater.session import sizing_conf


def test_sizing_scales_with_input():
    small = sizing_conf(100 * 1024 * 1024, 8)
    big = sizing_conf(100 * 1024 ** 4, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert int(big["spark.sql.shuffle.partitions"]) == 524288
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 * 1024 * 1024)


def test_rebalance_only_for_many_tasks(spark, sf_small):
    from tidewater.session import rebalance_for_write
    few = spark.read.parquet(f"{sf_small}/orders.parquet")
    assert rebalance_for_write(few) is few
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # pretend every 64 bytes is a task
    try:
        plan = rebalance_for_write(few)._jdf.queryExecution().optimizedPlan().toString()
        assert "RebalancePartitions" in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parse_bytes():
    from tidewater.session import parse_bytes
    assert parse_bytes("134217728b") == parse_bytes("128m") == parse_bytes("128MB") == 134217728
    assert parse_bytes("1g") == 1 << 30 and parse_bytes(42) == 42
