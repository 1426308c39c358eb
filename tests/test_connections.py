import json
import os
import subprocess
import sys

import pytest

from tidewater.errors import JobError
from tidewater.session import scratch_path
from tidewater.sources.connections import (
    jdbc_url,
    list_supported_types,
    qualified_table,
    source_from_connection,
    target_from_connection,
)
from tidewater.spec import job_from_dict

PG = {"type": "postgresql", "host": "db", "port": 5433, "database_name": "src", "username": "u", "password": "p",
      "extra_config": {"schema": "sales"}}


def test_dispatch_case_insensitive_and_unknown():
    assert list_supported_types() == ["POSTGRESQL", "MYSQL", "MSSQL", "CSV"]
    assert jdbc_url(PG) == "jdbc:postgresql://db:5433/src?sslmode=prefer"
    assert jdbc_url({"type": "MySQL", "host": "h", "database_name": "d"}).startswith("jdbc:mysql://h:3306/d")
    assert jdbc_url({"type": "mssql", "host": "h", "database_name": "d"}) == "jdbc:sqlserver://h:1433;databaseName=d"
    with pytest.raises(JobError) as e:
        jdbc_url({"type": "oracle"})
    assert "POSTGRESQL" in e.value.message


def test_quoting_and_specs():
    assert qualified_table(PG, "orders") == '"sales"."orders"'
    assert qualified_table({"type": "MYSQL"}, "orders") == "`orders`"
    src = source_from_connection(PG, {"table": "orders", "checkpoint_col": "updated_at"})
    assert src.kind == "jdbc" and src.table == '"sales"."orders"' and src.options["user"] == "u"
    q = source_from_connection(PG, {"query": "select 1"})
    assert q.query == "select 1" and q.table is None
    t = target_from_connection(PG, {"table": "fact"})
    assert t.kind == "jdbc" and t.options["driver"] == "org.postgresql.Driver"
    c = source_from_connection({"type": "CSV", "extra_config": {"file_path": "/x.csv", "delimiter": ";"}})
    assert c.kind == "csv" and c.path == "/x.csv" and c.options["delimiter"] == ";"


def test_job_from_connections():
    spec = job_from_dict({"name": "j", "source_connection": PG, "target_connection": PG,
                          "source_config": {"table": "orders"}, "target_config": {"table": "fact_orders"},
                          "load_strategy": "FULL_LOAD"})
    assert spec.source.kind == "jdbc" and spec.target.table == '"sales"."fact_orders"'


def test_csv_connection_job_runs(spark, sf_small):
    from tidewater.plans.runner import run_job
    from tidewater.plans.store import RunStore
    from tidewater.sources.sinks import write_frame
    from tidewater.spec import TargetSpec
    src_dir = scratch_path(spark, "csvconn")
    write_frame(spark, spark.read.parquet(f"{sf_small}/region.parquet"),
                TargetSpec(kind="csv", path=src_dir, options={"delimiter": ";"}), "FULL_LOAD")
    out_dir = scratch_path(spark, "csvconn_out")
    spec = job_from_dict({"name": "csvjob",
                          "source_connection": {"type": "csv", "extra_config": {"file_path": src_dir, "delimiter": ";"}},
                          "target_connection": {"type": "csv", "extra_config": {"output_path": out_dir}},
                          "column_mappings": [{"source_column": "r_name", "target_column": "r_name",
                                               "transform_rules": [{"transform_type": "LOWER", "apply_order": 0}]}]})
    res = run_job(spark, spec, RunStore(spark, scratch_path(spark, "csvconn_store")))
    assert res.status == "SUCCESS" and res.success_count == 5


def test_cli_run(sf_small, tmp_path):
    spec = {"name": "cli", "source_config": {"kind": "parquet", "path": f"{sf_small}/nation.parquet"},
            "target_config": {"kind": "parquet", "path": str(tmp_path / "out")},
            "validation_rules": [{"rule_type": "RANGE", "column": "n_regionkey", "params": {"max": 3}}]}
    p = tmp_path / "spec.json"
    p.write_text(json.dumps(spec))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-m", "tidewater", "--master", "local[2]", "--shuffle-partitions", "4",
                          "run", str(p), "--store", str(tmp_path / "store")],
                         cwd=root, capture_output=True, text=True, timeout=300)
    res = json.loads(out.stdout.strip().splitlines()[-1])
    assert out.returncode == 0 and res["status"] == "SUCCESS" and res["success_count"] == 20


def test_discovery_queries():
    from tidewater.sources.connections import describe_query, list_tables_query, logical_db_type
    assert "table_schema = 'sales'" in list_tables_query(PG) and "BASE TABLE" in list_tables_query(PG)
    assert "table_schema = database()" in list_tables_query({"type": "MYSQL"})
    q = describe_query(PG, "o'rders")
    assert "table_name = 'o''rders'" in q and q.endswith("order by ordinal_position")
    assert logical_db_type(PG, "character varying") == "VARCHAR"
    assert logical_db_type({"type": "MYSQL"}, "datetime") == "TIMESTAMP"
    assert logical_db_type(PG, "timestamp without time zone") == "TIMESTAMP WITHOUT TIME ZONE"


def test_cli_inspection_commands(spark, sf_small, tmp_path, capsys):
    from tidewater.__main__ import main
    store = str(tmp_path / "store")
    spec = {"name": "cli2", "source_config": {"kind": "parquet", "path": f"{sf_small}/region.parquet"},
            "target_config": {"kind": "parquet", "path": str(tmp_path / "out")},
            "validation_rules": [{"rule_type": "RANGE", "column": "r_regionkey", "params": {"max": 2}}]}
    p = tmp_path / "spec.json"
    p.write_text(json.dumps(spec))
    assert main(["run", str(p), "--store", store], spark=spark) == 0
    run_id = json.loads(capsys.readouterr().out.strip().splitlines()[-1])["run_id"]
    assert main(["preview", str(p), "--rows", "2"], spark=spark) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 2
    assert main(["describe", str(p)], spark=spark) == 0
    assert '"name": "r_regionkey"' in capsys.readouterr().out
    assert main(["runs", "--store", store], spark=spark) == 0
    assert run_id in capsys.readouterr().out
    assert main(["logs", "--store", store, "--run", run_id], spark=spark) == 0
    assert "JOB_SUCCESS" in capsys.readouterr().out
    assert main(["rejected", "--store", store, "--run", run_id], spark=spark) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 2
    assert spark.range(1).count() == 1  # the shared session is still alive
