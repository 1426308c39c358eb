"""One load run: read -> map + transform -> validate -> load -> advance the
high-water mark, with a run record, a step log and quarantined rows.

Spark shape: the spec becomes one lazy frame with flag columns; the actions
are (1) an emptiness probe (``limit 1``), (2) the violation append, whose
Observations also yield every rule's failure count and the source row count,
(3) the target write, whose Observation yields the rows written and the new
mark.  Only counters and a few log lines ever reach the driver.

Order of effects (keyed by run id): violations, STOP decision, target write, then ONE append of the run
record carrying its step log and the new mark — so a mark only ever becomes
visible together with its successful run.  A path target gets the rows and the load's receipt
(run, rows, marks) in one commit (:mod:`tidewater.sources.publish`).  A run that is lost between that
commit and its record has loaded its slice all the same: the next run of the job
finds the receipt and goes on behind it, and a run repeated under the same id loads nothing twice.

A source that need not give the same rows again (JDBC, a limit, SQL with a limit or
a random function, a frame handed in) is written once to the shared checkpoint folder, which both passes
read (:func:`repeats`).
"""

from __future__ import annotations

import logging
import time
import traceback
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.errors import JobError
from tidewater.fixed import STEP_MESSAGES as MSG
from tidewater.fixed import TEST_RUN_DEFAULT_ROWS
from tidewater.operators.drift import check_drift, drift_texts, null_checks
from tidewater.operators.mapping import apply_mappings
from tidewater.operators.rowindex import with_file_index, with_row_index
from tidewater.operators.validate import validate
from tidewater.plans.observed import Probe
from tidewater.plans.store import RunStore, utcnow
from tidewater.session import materialize, scratch_scope
from tidewater.sources import publish
from tidewater.sources.readers import BAD_ROW, CSV_VALUE, read_source
from tidewater.sources.sinks import PATH_KINDS, write_frame
from tidewater.spec import ColumnMapping, JobSpec, check_spec


@dataclass
class RunResult:
    run_id: str
    status: str
    source_count: int = 0
    success_count: int = 0
    rejected_count: int = 0
    rejected_rows: int = 0
    warnings: list[str] = field(default_factory=list)
    per_rule: list[dict] = field(default_factory=list)
    mark: str | None = None
    error_code: str | None = None
    error_message: str | None = None
    duration_seconds: float = 0.0


class _Log:
    def __init__(self, run_id: str):
        self.run_id = run_id
        self.rows: list[dict] = []

    def add(self, level: str, stage: str, message: str, detail: str | None = None) -> None:
        self.rows.append({"job_run_id": self.run_id, "seq": len(self.rows), "level": level, "stage": stage,
                          "message": message, "detail": detail, "created_at": utcnow()})

    def info(self, stage, message, detail=None):
        self.add("INFO", stage, message, detail)

    def warn(self, stage, message, detail=None):
        self.add("WARN", stage, message, detail)

    def error(self, stage, message, detail=None):
        self.add("ERROR", stage, message, detail)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mark_expr(df: DataFrame, name: str) -> Column:
    """The column's maximum; instants as text in the session's zone, so that the
    zone of the driver's host does not shift them."""
    top = F.max(F.col(_q(name)))
    return top.cast("string") if isinstance(df.schema[name].dataType, T.TimestampType) else top


def mark_text(value) -> str | None:
    """The mark as stored text (``str`` of the column maximum)."""
    return None if value is None else str(value)


def repeats(spec: JobSpec, df: DataFrame, limited: bool, given: bool) -> bool:
    """Whether reading the source again gives the same rows: files do; a cut without order, a database or a frame
    handed in (``given``) need not; SQL does unless it holds a limit, a sample or a random function."""
    if limited or given or spec.source.kind.lower() == "jdbc":
        return False
    if spec.source.kind.lower() in ("sql", "table"):
        plan = df._jdf.queryExecution().analyzed()
        text = plan.toString()
        return not any(x in text for x in ("GlobalLimit", "LocalLimit", "Sample ", "rand(", "randn(", "uuid(", "monotonically_increasing_id"))
    return True


def _plain_scan(df: DataFrame) -> bool:
    """Whether the frame is one scan of files and nothing else (then its rows' places are known)."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def _quarantine(store: RunStore, spec: JobSpec, run_id: str, started, bad_rows: DataFrame, res: RunResult, log: _Log) -> None:
    """Append the rows that do not parse to the violation store and count them (rows read, rows and records rejected)."""
    probe = Probe("bad-rows")
    watched = probe.attach(bad_rows, F.count(F.lit(1)).alias("rows"))
    reason = F.col(BAD_ROW)
    rows = watched.select(
        F.lit(run_id).alias("job_run_id"), F.lit(spec.id).alias("pipeline_id"), F.struct(reason["line"].alias("line")).alias("source_data"),
        F.lit(None).cast("int").alias("rule_index"), reason["column"].alias("error_column"), reason["rule"].alias("error_rule"),
        reason["message"].alias("error_message"), F.lit("REJECT").alias("action"), F.lit(started).alias("created_at"))
    store.append_violations(rows, spec.id, started.date())
    n = int(probe.result(rows).get("rows", 0) or 0)
    res.source_count += n
    res.rejected_rows += n
    res.rejected_count += n
    if n:
        log.warn("SOURCE_READ_DONE", f"{n:,} rows do not parse; they are kept as violations")


def run_job(spark: SparkSession, spec: JobSpec, store: RunStore | None = None, run_type: str = "MANUAL",
            test_limit: int | None = None, source_df: DataFrame | None = None, run_id: str | None = None,
            raise_on_error: bool = True, source_repeats: bool | None = None, seen: dict[str, DataFrame] | None = None) -> RunResult:
    """Execute one run of ``spec``; see the module docstring.  Intermediate
    folders the run writes to the shared checkpoint folder are removed when it
    ends.  ``source_repeats`` says that the source gives the same rows each time (None: see :func:`repeats`);
    ``seen`` gives, by column, values (column ``key``) that UNIQUE counts as taken already."""
    with scratch_scope(spark):
        return _run_job(spark, spec, store, run_type, test_limit, source_df, run_id, raise_on_error, source_repeats, seen)


def _run_job(spark: SparkSession, spec: JobSpec, store: RunStore | None, run_type: str,
             test_limit: int | None, source_df: DataFrame | None, run_id: str | None,
             raise_on_error: bool, source_repeats: bool | None, seen_keys: dict[str, DataFrame] | None) -> RunResult:
    store = store or RunStore.default(spark)
    repeated_id = run_id  # a run that the caller may repeat names itself
    run_id = run_id or uuid.uuid4().hex
    log = _Log(run_id)
    started = utcnow()
    res = RunResult(run_id=run_id, status="RUNNING")
    outcome = None
    is_test = run_type.upper() == "TEST"
    try:
        log.info("METADATA", MSG["METADATA"])
        check_spec(spec)
        strategy = spec.load_strategy.upper()
        log.info("SOURCE_CONNECT", MSG["SOURCE_CONNECT"].format(name=spec.source.table or spec.source.path or spec.source.kind))
        log.info("TARGET_CONNECT", MSG["TARGET_CONNECT"].format(name=spec.target.table or spec.target.path or spec.target.kind))

        # -- checkpoint (incremental), and what the last run of the job has left in the target
        mark = recorded = None
        path_target = spec.target.kind.lower() in PATH_KINDS
        left = publish.receipt_of(spark, spec.target.path, spec.id) if path_target and not is_test and strategy in ("INCREMENTAL", "APPEND") else None
        if left and repeated_id and left["run"] == repeated_id:
            log.warn("TARGET_WRITE_DONE", f"run {run_id} has loaded its {left['rows']:,} rows before; nothing is loaded again")
            res.success_count, res.mark, res.status = left["rows"], left["mark"], "SUCCESS"
            return res
        if strategy == "INCREMENTAL" and source_df is None:
            m = store.mark_of(spec.id)
            recorded = mark = m["checkpoint_value"] if m else None
            if left and left["mark"] is not None and left["from"] == recorded and left["mark"] != recorded:
                log.warn("CHECKPOINT", f"run {left['run']} left no record but {left['rows']:,} rows up to {left['mark']}")
                mark = res.mark = left["mark"]
            log.info("CHECKPOINT", MSG["CHECKPOINT"].format(value=mark, column=spec.source.checkpoint_col) if mark
                     else MSG["CHECKPOINT_FIRST"])

        # -- read
        log.info("SOURCE_READ_START", MSG["SOURCE_READ_START"])
        limit = (test_limit or TEST_RUN_DEFAULT_ROWS) if is_test else test_limit
        t0 = time.monotonic()
        src = source_df if source_df is not None else read_source(spark, spec.source, mark, limit)
        log.info("SOURCE_CONNECTED", MSG["SOURCE_CONNECTED"].format(ms=int((time.monotonic() - t0) * 1000)))
        if source_df is not None and limit:
            src = src.limit(int(limit))
        # Empty source: nothing is validated, written or truncated.  With rules
        # the violation pass observes the source count before the target is
        # touched, so only rule-less runs need the separate ``limit 1`` probe.
        if not spec.rules and src.isEmpty():
            log.info("NO_DATA", MSG["NO_DATA"])
            res.status = "SUCCESS"
            return res
        same_rows = repeats(spec, src, bool(limit), source_df is not None) if source_repeats is None else source_repeats
        if not same_rows and spec.rules and not spec.cache:
            src = materialize(src, "pinned-source")  # both passes read these rows
        source_repeats = spec.source.kind.lower() in ("parquet", "orc", "csv", "tsv", "txt", "json") and source_df is None and not limit \
            and not spec.cache and spec.mark_from != "source"
        bad_rows = None
        if BAD_ROW in src.columns:  # rows that do not parse: counted and kept as violations, never loaded
            bad_rows = src.where(F.col(BAD_ROW).isNotNull())
            src = src.where(F.col(BAD_ROW).isNull()).drop(BAD_ROW)
        # row numbers: Parquet files tell them, where every row that is read stays
        numbered = bool(spec.row_index and spec.rules and source_repeats and same_rows and mark is None and spec.source.kind.lower() == "parquet"
                        and not any(t.transform_type.upper() == "NULL_HANDLING" for m in spec.mappings for t in m.transform_rules)
                        and _plain_scan(src))
        maps = spec.mappings
        if numbered:
            src = with_file_index(src, "__row_number")
            maps = (*maps, ColumnMapping("__row_number", "__row_number", 1 << 30)) if maps else maps
        src_probe = Probe("src")
        nulls = null_checks(src, spec.expected_schema, spec.schema_drift_action)
        src_exprs = [F.count(F.lit(1)).alias("rows"), *nulls]
        cp_col = spec.source.checkpoint_col
        if strategy == "INCREMENTAL" and spec.mark_from == "source" and cp_col in src.columns:
            src_exprs.append(mark_expr(src, cp_col).alias("mark"))
        raw_src = src  # for emptiness probes: never run a limit-1 job through the observation
        src = src_probe.attach(src, *src_exprs)
        executed: list[DataFrame] = []  # frames whose plans ran (for the source probe)

        # -- drift: the schema now; NULLs where none are expected are counted by the pass that counts the source
        for w in check_drift(src.drop("__row_number"), spec.expected_schema, spec.schema_drift_action, data=False):
            log.warn("SCHEMA_DRIFT", w)

        def check_nulls(seen: dict) -> None:
            for w in drift_texts(spec.expected_schema, spec.schema_drift_action, seen):
                log.warn("SCHEMA_DRIFT", w)

        # -- map + transform (excluded mappings are dropped; see README)
        mapped = src
        sources = {c: c for c in src.columns}
        if spec.mappings:
            log.info("MAPPING", MSG["MAPPING"].format(n=len(spec.mappings)))
            mr = apply_mappings(src, maps, keep_unmapped=spec.keep_unmapped)
            mapped, sources = mr.frame, mr.source_names
            for w in mr.warnings:
                log.warn("MAPPING", w)
            log.info("TRANSFORM_DONE", MSG["TRANSFORM_DONE"])

        extra = []
        if numbered:
            extra = ["__row_number"]
        elif spec.row_index:
            executed.append(mapped)  # it is written once here, which the source probe sees
            mapped = with_row_index(mapped, "__row_number")
            extra = ["__row_number"]

        # -- validate
        valid = mapped.drop(*extra) if extra else mapped
        if spec.rules:
            log.info("VALIDATION_START", MSG["VALIDATION_START"].format(n=len(spec.rules)))
            outcome = validate(mapped, spec.rules, extra_columns=extra, persist=spec.cache, seen=seen_keys)
            for i in outcome.skipped:
                log.warn("VALIDATION_START", f"rule {i} ({spec.rules[i].rule_type}) skipped: column missing or no-op")
        if outcome is not None and outcome.rules:
            # One pass both appends the violation records and, through an
            # Observation on the flagged frame, counts every rule's failures.
            rule_probe = Probe("rules")
            observed = rule_probe.attach(outcome.flagged, *outcome.count_exprs())
            viol = outcome.violations(row_key=spec.row_key, include_source=True,
                                      row_number_col=extra[0] if extra else None, frame=observed)
            viol = viol.select(F.lit(run_id).alias("job_run_id"), F.lit(spec.id).alias("pipeline_id"), "*",
                               F.lit(started).alias("created_at"))
            store.append_violations(viol, spec.id, started.date())
            executed.append(viol)
            got = rule_probe.result(viol)
            if not got:
                # no rule can fail (all predicates constant false): count once
                got = outcome.flagged.agg(*outcome.count_exprs()).collect()[0].asDict()
                executed.append(outcome.flagged)
            counts = {k: int(v or 0) for k, v in got.items()}
            seen = src_probe.result(*executed)
            res.source_count = int(seen.get("rows", 0) or 0)
            if bad_rows is not None:
                _quarantine(store, spec, run_id, started, bad_rows, res, log)
            log.info("SOURCE_READ_DONE", MSG["SOURCE_READ_DONE"].format(n=res.source_count))
            if nulls:
                check_nulls(seen)
            if counts.get("__rows", 0) == 0 and res.source_count == 0:
                log.info("NO_DATA", MSG["NO_DATA"])
                res.status = "SUCCESS"
                return res
            res.per_rule += outcome.per_rule(counts)
            res.rejected_rows += counts["__rejected_rows"]
            res.rejected_count += outcome.violation_record_count(counts)
            for w in outcome.warnings(counts):
                log.warn("VALIDATION_WARN", w)
                res.warnings.append(w)
            if res.rejected_count:
                log.warn("VALIDATION_DONE", MSG["VALIDATION_REJECTED"].format(n=res.rejected_count))
            # STOP: violations are kept, the target is not touched
            outcome.check_stop(counts)
            valid = outcome.valid()
            if source_repeats and not spec.row_index and all(r.rule_type not in ("UNIQUE", "DUPLICATE_CHECK") for r in outcome.rules):
                # the source's rows are counted: without the observation the valid side's filters reach its scan
                again = apply_mappings(raw_src, spec.mappings, keep_unmapped=spec.keep_unmapped).frame if spec.mappings else raw_src
                valid = validate(again, spec.rules, persist=False).valid()
            log.info("VALIDATION_DONE", MSG["VALIDATION_DONE"].format(n=counts["__rows"] - counts["__rejected_rows"]))

        if bad_rows is not None and (outcome is None or not outcome.rules):
            _quarantine(store, spec, run_id, started, bad_rows, res, log)

        # rules were given but none applies: no violation pass observed the
        # source, so probe it before a FULL_LOAD could truncate the target
        if spec.rules and (outcome is None or not outcome.rules) and raw_src.isEmpty():
            log.info("NO_DATA", MSG["NO_DATA"])
            res.status = "SUCCESS"
            return res

        # -- load
        mark_col = None
        if strategy == "INCREMENTAL" and cp_col and spec.mark_from == "valid":
            # resolve the source column through the mapping (a rename keeps the mark)
            mark_col = next((o for o, s in sources.items() if s == cp_col and o in valid.columns), None)
        executed.append(valid)
        if is_test:
            res.success_count = valid.count()
            log.info("TARGET_WRITE_DONE", f"TEST: {res.success_count:,} rows, target not written")
        else:
            log.info("TARGET_WRITE_START", MSG["TARGET_WRITE_START"].format(strategy=strategy))
            obs_exprs = [mark_expr(valid, mark_col).alias("mark")] if mark_col else []
            counted = outcome is not None and bool(outcome.rules)

            def mark_after(got: dict):
                if strategy == "INCREMENTAL" and spec.mark_from == "source":
                    return src_probe.result(*executed).get("mark")
                return got.get("mark") if mark_col else None

            def receipt(got: dict) -> dict | None:
                """What goes into the commit; nothing is committed if this raises."""
                if nulls and not counted:
                    check_nulls(src_probe.result(*executed))
                if strategy not in ("APPEND", "INCREMENTAL"):
                    return None
                new = mark_text(mark_after(got)) or res.mark
                return {"job": spec.id, "run": run_id, "rows": int(got.get("rows", 0) or 0), "from": recorded, "mark": new}

            if nulls and not counted and not path_target:
                check_nulls(raw_src.agg(*nulls).first().asDict())
            wr = write_frame(spark, valid, spec.target, strategy, spec.upsert_keys, spec.order_by,
                             spec.batch_size, obs_exprs, receipt)
            res.success_count = wr.rows_written
            log.info("TARGET_CONNECTED", MSG["TARGET_CONNECTED"].format(ms=wr.connect_ms))
            log.info("TARGET_WRITE_DONE", MSG["TARGET_WRITE_DONE"].format(n=wr.rows_written))
            new_mark = mark_after(wr.observed or {})
            if strategy == "INCREMENTAL" and new_mark is not None:
                # stored with the run record (one append, after the target write)
                res.mark = mark_text(new_mark)
                log.info("CHECKPOINT_UPDATED", MSG["CHECKPOINT_UPDATED"].format(value=res.mark))
        if not spec.rules or outcome is None or not outcome.rules:
            res.source_count += int(src_probe.result(*executed).get("rows", 0) or 0)
            log.info("SOURCE_READ_DONE", MSG["SOURCE_READ_DONE"].format(n=res.source_count))
        res.status = "SUCCESS"
        log.info("JOB_SUCCESS", MSG["JOB_SUCCESS"])
        return res
    except JobError as e:
        res.status, res.error_code, res.error_message = "FAILED", e.code, e.message
        log.error("JOB_FAILED", e.message, e.detail)
        if raise_on_error:
            raise
        return res
    except Exception as e:  # noqa: BLE001
        code = "READ_FAILED" if CSV_VALUE in str(e) or "MALFORMED_" in str(e) else "UNEXPECTED"
        res.status, res.error_code, res.error_message = "FAILED", code, MSG["JOB_UNEXPECTED"].format(error=e)
        log.error("JOB_FAILED", res.error_message, traceback.format_exc())
        if raise_on_error:
            raise
        return res
    finally:
        if outcome is not None:
            outcome.unpersist()
        finished = utcnow()
        res.duration_seconds = (finished - started).total_seconds()
        record = {
            "id": run_id, "pipeline_id": spec.id, "status": res.status, "run_type": run_type.upper(),
            "started_at": started, "finished_at": finished, "duration_seconds": res.duration_seconds,
            "source_count": res.source_count, "target_count": res.success_count,
            "success_count": res.success_count, "error_count": 0 if res.status == "SUCCESS" else None,
            "rejected_count": res.rejected_count, "rejected_rows": res.rejected_rows,
            "error_message": res.error_message,
            "error_detail": next((r["detail"] for r in reversed(log.rows) if r["level"] == "ERROR"), None), "created_at": started,
            "checkpoint_column": spec.source.checkpoint_col if res.mark is not None else None,
            "checkpoint_value": res.mark if res.status == "SUCCESS" else None,
        }
        try:
            store.append_run(record, log.rows)
        except Exception:  # noqa: BLE001
            if res.status == "SUCCESS":
                raise  # the load happened but its record could not be written: surface it
            # a failed run keeps its own error; the record failure is secondary
            logging.getLogger("tidewater").exception("could not append the run record of %s", run_id)
