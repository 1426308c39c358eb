"""Run store: append-only Parquet tables below one shared folder.

* ``run_records`` — one row per run: state, counts, error, the high-water mark the
  run produced and its step log as an array of structs, in a folder for each job and, in it, for each day on
  which runs were recorded.  The whole record is
  one append, so a run, its log and its mark become visible together (or not
  at all).  (``runs``, the flat table of earlier versions, is still read.)
* ``mark_snapshot`` — the marks of all runs recorded before a day.  A job's mark is read
  from there and from the job's folders of that day and later, whatever the length of the history.
* ``violations`` — one row per (row, failing rule), a folder for each job and
  row shape, in it one for each run date (:meth:`violations_of` reads only
  those of its run); the failing row is kept as a typed struct.

Views: :meth:`logs` explodes the step logs, :meth:`marks` is the latest mark
per job (an aggregate over successful runs).  Append-only keeps writers from
ever overwriting something a reader uses; :meth:`compact` rewrites closed days only, by
:mod:`tidewater.sources.publish`, while other runs append.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.session import ensure_checkpoint_dir

LOG_STRUCT = ("struct<seq:int, level:string, stage:string, message:string, detail:string, "
              "created_at:timestamp_ntz>")
RUNS_SCHEMA = (
    "id string, pipeline_id string, status string, run_type string, started_at timestamp_ntz, "
    "finished_at timestamp_ntz, duration_seconds double, source_count bigint, target_count bigint, "
    "success_count bigint, error_count bigint, rejected_count bigint, rejected_rows bigint, "
    "error_message string, error_detail string, created_at timestamp_ntz, "
    f"checkpoint_column string, checkpoint_value string, logs array<{LOG_STRUCT}>"
)
LOGS_SCHEMA = ("job_run_id string, seq int, level string, stage string, message string, detail string, "
               "created_at timestamp_ntz")
MARKS_SCHEMA = ("pipeline_id string, checkpoint_column string, checkpoint_value string, "
                "updated_at timestamp_ntz, job_run_id string")


RECORDS, SNAPSHOT = "run_records", "mark_snapshot"


def utcnow() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def _short(text: str) -> str:
    """A folder name for any text."""
    return hashlib.sha1(text.encode()).hexdigest()[:16]


@dataclass
class RunStore:
    spark: SparkSession
    base: str

    @classmethod
    def default(cls, spark: SparkSession) -> "RunStore":
        return cls(spark, f"{ensure_checkpoint_dir(spark)}/tidewater-store")

    def path(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"

    def _exists(self, name: str) -> bool:
        from tidewater.sources.sinks import path_exists
        return path_exists(self.spark, self.path(name))

    # ------------------------------------------------------------------ reads
    def records(self, pipeline_id: str | None = None, since: _dt.date | None = None, before: _dt.date | None = None) -> DataFrame:
        """Run records with their logs, of one job or all, recorded from ``since`` on and before ``before``: filters on
        the folders, so that nothing else is listed as input."""
        from tidewater.sources import publish
        frames = []
        if publish.exists(self.spark, self.path(RECORDS)):
            def load(paths, base):
                reader = self.spark.read.schema(RUNS_SCHEMA + ", job string, day date")
                return (reader.option("basePath", base) if paths != [base] else reader).parquet(*paths)
            found = publish.load_live(self.spark, self.path(RECORDS), load)
            if pipeline_id is not None:
                found = found.where((F.col("job") == _short(pipeline_id)) & (F.col("pipeline_id") == pipeline_id))
            if since is not None:
                found = found.where(F.col("day") >= F.lit(since))
            if before is not None:
                found = found.where(F.col("day") < F.lit(before))
            frames.append(found.drop("job", "day"))
        if self._exists("runs"):  # the flat table of earlier versions
            old = self.spark.read.schema(RUNS_SCHEMA).parquet(self.path("runs"))
            day = F.col("finished_at").cast("date")
            if pipeline_id is not None:
                old = old.where(F.col("pipeline_id") == pipeline_id)
            if since is not None:
                old = old.where(day >= F.lit(since))
            if before is not None:
                old = old.where(day < F.lit(before))
            frames.append(old)
        if not frames:
            return self.spark.createDataFrame([], RUNS_SCHEMA)
        return reduce(DataFrame.unionByName, frames)

    def runs_with_logs(self) -> DataFrame:
        return self.records()

    def runs(self) -> DataFrame:
        """Run records (without the nested step log)."""
        return self.runs_with_logs().drop("logs")

    def logs(self) -> DataFrame:
        """Step-log rows of every run."""
        r = self.runs_with_logs()
        return (r.select(F.col("id").alias("job_run_id"), F.explode("logs").alias("l"))
                 .select("job_run_id", "l.seq", "l.level", "l.stage", "l.message", "l.detail", "l.created_at"))

    def _snapshot(self) -> tuple[DataFrame | None, _dt.date | None]:
        """(marks of the runs recorded before a day, that day)."""
        from tidewater.sources import publish
        if not publish.exists(self.spark, self.path(SNAPSHOT)):
            return None, None
        rows = publish.load_live(self.spark, self.path(SNAPSHOT), lambda paths, base: self.spark.read.schema(MARKS_SCHEMA + ", as_of date").parquet(*paths))
        head = rows.where(F.col("pipeline_id").isNull()).select("as_of").first()
        return rows.where(F.col("pipeline_id").isNotNull()).drop("as_of"), head["as_of"] if head else None

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        """The latest of a job's marks."""
        latest = F.max_by(F.struct("checkpoint_column", "checkpoint_value", "updated_at", "job_run_id"), F.col("updated_at"))
        return rows.groupBy("pipeline_id").agg(latest.alias("m")).select("pipeline_id", "m.*")

    @staticmethod
    def _marks_in(records: DataFrame) -> DataFrame:
        found = records.where((F.col("status") == "SUCCESS") & F.col("checkpoint_value").isNotNull())
        return found.select("pipeline_id", "checkpoint_column", "checkpoint_value", F.col("finished_at").alias("updated_at"), F.col("id").alias("job_run_id"))

    def marks(self, pipeline_id: str | None = None) -> DataFrame:
        """Latest high-water mark per job, or of one (from successful runs that set one)."""
        old, as_of = self._snapshot()
        rows = self._marks_in(self.records(pipeline_id, since=as_of))
        if old is not None:
            rows = rows.unionByName(old if pipeline_id is None else old.where(F.col("pipeline_id") == pipeline_id))
        return self._latest(rows)

    def mark_of(self, pipeline_id: str) -> dict | None:
        rows = self.marks(pipeline_id).collect()
        return rows[0].asDict() if rows else None

    def _shapes(self, pipeline_id: str | None = None) -> list[str]:
        """Folders of the violations, one for each job and row shape."""
        from tidewater.sources.sinks import _fs
        job = "job=*" if pipeline_id is None else f"job={_short(pipeline_id)}"
        fs, p = _fs(self.spark, self.path(f"violations/{job}/shape=*"))
        return sorted(st.getPath().toString() for st in fs.globStatus(p) or [] if st.isDirectory())

    def violations(self, pipeline_id: str | None = None) -> DataFrame | None:
        """Violation records of all jobs, or of one (None before the first one was written).

        Every folder holds rows of one shape.  Where shapes differ, columns are
        united by name; one that has several types becomes JSON text.
        """
        frames = []
        for path in self._shapes(pipeline_id):
            try:
                frames.append(self.spark.read.parquet(path))
            except AnalysisException as e:  # only empty appends so far
                if (e.getCondition() or "") != "UNABLE_TO_INFER_SCHEMA":
                    raise
        if not frames:
            return None
        kinds: dict[str, set] = {}
        for f in frames:
            for x in f.schema.fields:
                kinds.setdefault(x.name, set()).add(x.dataType.simpleString())
        mixed = [n for n, k in kinds.items() if len(k) > 1]
        if mixed:
            def text(f, n):
                nested = isinstance(f.schema[n].dataType, (T.StructType, T.ArrayType, T.MapType))
                return F.to_json(F.col(n)) if nested else F.col(n).cast("string")
            frames = [f.withColumns({n: text(f, n) for n in mixed if n in f.columns}) for f in frames]
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)

    def violations_of(self, run_id: str) -> DataFrame | None:
        """Violation records of one run: its job's folders, pruned to the day it started."""
        run = self.runs().where(F.col("id") == run_id).select("pipeline_id", "started_at").first()
        found = self.violations(run.pipeline_id) if run else self.violations()
        if found is None:
            return None
        if run:
            found = found.where(F.col("run_date") == F.lit(run.started_at.date()))
        return found.where(F.col("job_run_id") == run_id)

    # ----------------------------------------------------------------- writes
    def append_run(self, record: dict, logs: list[dict]) -> None:
        """One append: the run record with its step log and mark."""
        row = dict(record)
        row["logs"] = [{k: l[k] for k in ("seq", "level", "stage", "message", "detail", "created_at")}
                       for l in logs]
        folder = f"{self.path(RECORDS)}/job={_short(row['pipeline_id'])}/day={row['finished_at'].date().isoformat()}"
        schema = T.DataType.fromDDL(RUNS_SCHEMA)
        rows = pa.Table.from_pylist([row], schema=to_arrow_schema(schema))  # a local relation: one small job
        self.spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)

    def append_records(self, records: DataFrame) -> None:
        """Append any number of run records (``RUNS_SCHEMA``), each under its job and the day it finished."""
        job = F.substring(F.sha1(F.col("pipeline_id").cast("binary")), 1, 16)
        records.withColumns({"job": job, "day": F.col("finished_at").cast("date")}).write.mode("append").partitionBy("job", "day").parquet(self.path(RECORDS))

    def compact(self, before: _dt.date | None = None) -> int:
        """Rewrite the small files of days before ``before`` (None: yesterday, so that no run still appends to
        them) into one for each job and day, and take the marks of those days into the snapshot.

        Runs may go on appending: only the files that were read are replaced, in one commit.  Violations
        need no compaction: each run appends them with a distributed write
        sized by the data.  Returns the number of files replaced."""
        from tidewater.sources import publish
        before = before or utcnow().date() - _dt.timedelta(days=1)
        root, small = self.path(RECORDS), []
        if publish.exists(self.spark, root):
            publish.settle(self.spark, root)
            folders: dict[str, list[str]] = {}
            for f in publish.data_files(self.spark, root):
                folder = f.rsplit("/", 1)[0]
                if folder.rsplit("day=", 1)[-1] < before.isoformat():
                    folders.setdefault(folder, []).append(f)
            small = [f for files in folders.values() if len(files) > 1 for f in files]
        if small:
            rows = self.spark.read.schema(RUNS_SCHEMA + ", job string, day date").option("basePath", root).parquet(*[f"{root}/{f}" for f in small])
            staging = publish.staging_path(root)
            rows.repartition("job", "day").write.partitionBy("job", "day").parquet(staging)
            publish.publish(self.spark, root, staging, removes=small)
        old, as_of = self._snapshot()
        if as_of is None or as_of < before:
            rows = self._marks_in(self.records(since=as_of, before=before))
            rows = self._latest(rows.unionByName(old) if old is not None else rows).withColumn("as_of", F.lit(before))
            head = self.spark.createDataFrame([(None, None, None, None, None, before)], MARKS_SCHEMA + ", as_of date")
            staging = publish.staging_path(self.path(SNAPSHOT))
            rows.unionByName(head).coalesce(1).write.parquet(staging)
            publish.publish(self.spark, self.path(SNAPSHOT), staging, replace=True)
        return len(small)

    def append_violations(self, df: DataFrame, pipeline_id: str, run_date: _dt.date) -> None:
        """Distributed append of a run's violations to the folder of its job, row shape and day.

        Violations are a sparse filter over the whole
        scan: written straight from a million scan tasks they would make a
        million tiny files, so such plans are rebalanced first (AQE sizes the
        output files by bytes; see :func:`tidewater.session.rebalance_for_write`)."""
        from tidewater.session import rebalance_for_write
        shape = _short(df.schema.simpleString())
        rebalance_for_write(df).write.mode("append").parquet(
            self.path(f"violations/job={_short(pipeline_id)}/shape={shape}/run_date={run_date.isoformat()}"))


def violations_as_json(violations: DataFrame) -> DataFrame:
    """Export form: the failing row as JSON text with microsecond timestamps
    (``to_json`` would otherwise cut naive timestamps to milliseconds)."""
    return violations.withColumn(
        "source_data", F.to_json(F.col("source_data"), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}))
