"""Run-history queries: dashboard counters, recent runs, paging, run log,
rejected rows of a run, violation profile.

Inputs are DataFrames with the run-store schemas (see
:mod:`tidewater.plans.store`): ``runs(id, pipeline_id, status, run_type,
started_at, finished_at, duration_seconds, source_count, success_count,
error_count, rejected_count, created_at)``, ``pipelines(id, name, status)``,
``logs(job_run_id, level, stage, message, created_at)`` and
``violations(job_run_id, row_number, error_column, error_rule, ...)``.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.fixed import MISSING_PIPELINE_NAME, RECENT_RUNS_DEFAULT, REJECTED_PAGE_DEFAULT, RUN_PAGE_DEFAULT


def _day_start(as_of) -> Column:
    if as_of is None:
        return F.date_trunc("day", F.current_timestamp().cast("timestamp_ntz")).cast("timestamp_ntz")
    if isinstance(as_of, (_dt.date, _dt.datetime)):
        as_of = as_of.isoformat(sep=" ") if isinstance(as_of, _dt.datetime) else as_of.isoformat()
    return F.date_trunc("day", F.lit(str(as_of)).cast("timestamp_ntz")).cast("timestamp_ntz")


def pipeline_counts(pipelines: DataFrame) -> DataFrame:
    """R1: total pipelines and ACTIVE ones, one pass."""
    return pipelines.agg(F.count(F.lit(1)).alias("total_pipelines"),
                         F.count_if(F.col("status") == "ACTIVE").alias("active_pipelines"))


def run_stats(runs: DataFrame, as_of=None) -> DataFrame:
    """R2-R4 in ONE aggregate pass: today's SUCCESS / FAILED counts, rows
    loaded today by successful runs (null -> 0) and the mean duration of all
    successful runs rounded to one decimal (null -> 0)."""
    today = F.col("created_at") >= _day_start(as_of)
    ok = F.col("status") == "SUCCESS"
    return runs.agg(
        F.count_if(today & ok).alias("today_success_jobs"),
        F.count_if(today & (F.col("status") == "FAILED")).alias("today_failed_jobs"),
        F.coalesce(F.sum(F.when(today & ok, F.col("success_count"))), F.lit(0)).cast("bigint").alias("today_rows_transferred"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("duration_seconds"))), F.lit(0.0)), 1).alias("avg_duration_seconds"),
    )


def dashboard(pipelines: DataFrame, runs: DataFrame, as_of=None) -> DataFrame:
    """R1-R4 as one row.

    The pipeline counters are a one-row aggregate fetched to the driver (its
    size is fixed at one row) and attached as literals to the one-row run
    aggregate — no join, no cartesian product.
    """
    pc = pipeline_counts(pipelines).collect()[0]
    return run_stats(runs, as_of).select(
        F.lit(int(pc["total_pipelines"])).cast("bigint").alias("total_pipelines"),
        F.lit(int(pc["active_pipelines"])).cast("bigint").alias("active_pipelines"),
        "*",
    )


def recent_runs(runs: DataFrame, pipelines: DataFrame, limit: int = RECENT_RUNS_DEFAULT,
                order_cols=("created_at", "id")) -> DataFrame:
    """R5: newest ``limit`` runs with their pipeline name ("—" when absent).

    The top-k runs as TakeOrderedAndProject (each partition keeps its best k).
    The name lookup never broadcasts the pipeline table: a semi-join with the
    k run keys (broadcast, at most k rows) shrinks it to at most k rows, and
    only that is broadcast into the left join.
    """
    k = int(limit)
    top = runs.orderBy(*[F.col(c).desc() for c in order_cols]).limit(k)
    ids = top.select(F.col("pipeline_id").alias("id")).distinct()
    names = (pipelines.join(F.broadcast(ids), "id", "left_semi")
             .select(F.col("id").alias("pipeline_id"), F.col("name").alias("pipeline_name")))
    out = top.join(F.broadcast(names), "pipeline_id", "left")
    cols = [c for c in top.columns if c != "pipeline_id"]
    return out.select(*cols, "pipeline_id",
                      F.coalesce(F.col("pipeline_name"), F.lit(MISSING_PIPELINE_NAME)).alias("pipeline_name"))


def list_runs(runs: DataFrame, pipeline_id=None, status: str | None = None,
              limit: int = RUN_PAGE_DEFAULT, offset: int = 0, order_cols=("created_at", "id")) -> DataFrame:
    """R6: optional filters (status upper-cased), newest first, one page."""
    df = runs
    if pipeline_id is not None:
        df = df.where(F.col("pipeline_id") == F.lit(pipeline_id))
    if status:
        df = df.where(F.col("status") == F.lit(status.upper()))
    df = df.orderBy(*[F.col(c).desc() for c in order_cols])
    if offset:
        df = df.offset(int(offset))
    return df.limit(int(limit))


def page_token(row, order_cols=("created_at", "id")) -> str:
    """Where the next page begins: the last row's order columns, as text that a caller can keep."""
    return json.dumps([None if row[c] is None else str(row[c]) for c in order_cols])


def page_after(runs: DataFrame, token: str | None = None, limit: int = RUN_PAGE_DEFAULT, order_cols=("created_at", "id")) -> DataFrame:
    """R6 by seeking: the ``limit`` newest rows behind ``token`` (None: the first page).

    The order columns must be unique together and are never NULL.  The bound is a filter, which reaches the scan, and the page a top-k
    (every task keeps its best ``limit``): a deep page costs what the first one does, where an offset sorts and skips all rows before it.
    """
    df = runs
    if token is not None:
        types = {f.name: f.dataType for f in runs.schema.fields}
        last = [F.lit(v).cast(types[c]) for c, v in zip(order_cols, json.loads(token))]
        behind, equal = F.lit(False), F.lit(True)
        for c, v in zip(order_cols, last):
            behind = behind | (equal & (F.col(c) < v))
            equal = equal & (F.col(c) == v)
        # said of the first column alone as well: a range that the scan understands
        df = df.where((F.col(order_cols[0]) <= last[0]) & behind)
    return df.orderBy(*[F.col(c).desc() for c in order_cols]).limit(int(limit))


def run_log(logs: DataFrame, job_run_id=None, order_cols=("created_at",)) -> DataFrame:
    """R7: log rows of one run (or of every run) in time order."""
    df = logs if job_run_id is None else logs.where(F.col("job_run_id") == F.lit(job_run_id))
    keys = ([] if job_run_id is not None else ["job_run_id"]) + list(order_cols)
    return df.orderBy(*keys)


def rejected_of_run(violations: DataFrame, job_run_id=None, limit: int = REJECTED_PAGE_DEFAULT,
                    order_cols=("row_number",)) -> DataFrame:
    """R8: first ``limit`` violation records of a run (ordered, so "first" is stable)."""
    df = violations if job_run_id is None else violations.where(F.col("job_run_id") == F.lit(job_run_id))
    return df.orderBy(*order_cols).limit(int(limit))


def violation_profile(violations: DataFrame) -> DataFrame:
    """R11: violation records per (rule, column)."""
    return violations.groupBy("error_rule", "error_column").agg(F.count(F.lit(1)).alias("violations"))
