"""Scheduled / continuous incremental loads on Structured Streaming.

A file (or table) stream feeds ``foreachBatch``; every micro-batch is one run
of the job (map, validate, load, run record).  The stream's own checkpoint
(in the run store unless given, one for each job, so a
restart loads nothing twice) tracks which input was
processed, so no high-water mark is needed and late files are not skipped.

``trigger="availableNow"`` processes what exists and stops (a scheduled run);
``trigger="<n> seconds"`` keeps running (an interval schedule).

Replays: after a failure Spark may hand the same batch id to
``foreachBatch`` again.  Runs are keyed ``<stream key>-batch-<id>`` where the
stream key is derived from the checkpoint location (stable across restarts of
the same stream).  Batch ids only grow, so the highest id recorded as SUCCESS
(one single-row aggregate over the run store, read when the stream starts)
tells which handed-over batches were already loaded; those are skipped, and one that a lost driver
committed without a record is found by the receipt in the target, so an
APPEND target does not receive a batch twice.  UPSERT and FULL_LOAD targets
are idempotent anyway.

UNIQUE looks within a batch unless :class:`UniqueAcross` is given.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators.mapping import apply_mappings
from tidewater.plans.runner import run_job
from tidewater.plans.store import RunStore
from tidewater.sources.readers import BAD_ROW, read_csv
from tidewater.spec import JobSpec, ValidationRule


def stream_key(spec: JobSpec, checkpoint_location: str) -> str:
    return f"{spec.id}-{hashlib.sha1(checkpoint_location.encode()).hexdigest()[:10]}"


def last_loaded_batch(store: RunStore, key: str, pipeline_id: str | None = None) -> int:
    """Highest batch id of this stream recorded as SUCCESS (-1 if none); only the job's records are read."""
    prefix = f"{key}-batch-"
    ids = (store.records(pipeline_id).where(F.col("id").startswith(prefix) & (F.col("status") == "SUCCESS"))
           .select(F.substring(F.col("id"), len(prefix) + 1, 1 << 20).cast("bigint").alias("b")))
    got = ids.agg(F.max("b")).collect()[0][0]
    return -1 if got is None else int(got)


@dataclass(frozen=True)
class UniqueAcross:
    """UNIQUE over all micro-batches of a stream: a value of ``column`` (after mapping) that an earlier batch held fails, beside
    the values that occur twice in a batch.

    With a time column, keys count for ``within`` (an interval) behind the latest time of earlier batches, so that
    what is remembered does not grow for ever; rows older than that are *late*: a RANGE rule on the time column counts
    them, with ``late_action``.
    """
    column: str
    time_column: str | None = None
    within: str = "7 days"
    late_action: str = "WARN"


class SeenKeys:
    """Keys of the batches of a stream, one folder for each batch (written again if a batch is repeated), in it one for each day."""

    def __init__(self, store: RunStore, key: str, unique: UniqueAcross):
        self.store, self.unique = store, unique
        self.path = store.path(f"keys/{hashlib.sha1((key + '/' + unique.column).encode()).hexdigest()[:16]}")

    def before(self, batch_id: int, kind: T.DataType) -> tuple[DataFrame | None, str | None]:
        """(keys that count for a batch, the time before which its rows are late)."""
        from tidewater.sources.sinks import path_exists
        spark = self.store.spark
        if not path_exists(spark, self.path):
            return None, None
        schema = T.StructType([T.StructField("key", kind), T.StructField("at", T.TimestampNTZType()), T.StructField("batch", T.LongType()), T.StructField("day", T.DateType())])
        keys = spark.read.schema(schema).parquet(self.path).where(F.col("batch") < batch_id)
        if self.unique.time_column is None:
            return keys.select("key"), None
        top = keys.agg((F.max("at") - F.expr(f"INTERVAL {self.unique.within}")).cast("string").alias("t")).first()["t"]
        if top is None:
            return None, None
        mark = F.lit(top).cast("timestamp_ntz")
        return keys.where((F.col("day") >= mark.cast("date")) & (F.col("at") >= mark)).select("key"), top

    def add(self, batch_id: int, rows: DataFrame) -> None:
        """Remember the keys of a batch (with the latest time of each)."""
        u = self.unique
        at = F.max(F.col(f"`{u.time_column}`").cast("timestamp_ntz")) if u.time_column else F.lit(None).cast("timestamp_ntz")
        keys = rows.groupBy(F.col(f"`{u.column}`").alias("key")).agg(at.alias("at")).withColumn("day", F.col("at").cast("date"))
        keys.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/batch={batch_id}")


def batch_runner(spec: JobSpec, store: RunStore, key: str, prepare=None, repeats: bool | None = None, unique: UniqueAcross | None = None):
    """The ``foreachBatch`` function: one run per micro-batch, replay-safe.

    ``prepare`` turns each batch into the rows to load (e.g. the files of a CSV stream); ``repeats`` says
    that a batch gives the same rows each time.  A batch that was committed to the target but not recorded is recorded
    without loading it again (its receipt is in the target)."""
    state = {"done": last_loaded_batch(store, key, spec.id)}
    seen = SeenKeys(store, key, unique) if unique else None

    def one_batch(batch_df: DataFrame, batch_id: int) -> None:
        if batch_id <= state["done"]:
            return  # replayed batch already loaded
        if prepare is not None:
            batch_df = prepare(batch_df)
            if batch_df is None:
                return
        job, known = spec, None
        if seen is not None:
            mapped = apply_mappings(batch_df.drop(BAD_ROW), spec.mappings, keep_unmapped=spec.keep_unmapped).frame if spec.mappings else batch_df.drop(BAD_ROW)
            keys, late = seen.before(batch_id, mapped.schema[unique.column].dataType)
            if keys is not None:
                known = {unique.column: keys}
            if late is not None:
                job = replace(spec, rules=(*spec.rules, ValidationRule("RANGE", unique.time_column, {"min": late}, unique.late_action)))
        res = run_job(batch_df.sparkSession, job, store, run_type="SCHEDULED", source_df=batch_df,
                      run_id=f"{key}-batch-{batch_id}", source_repeats=repeats, seen=known)
        if res.status == "SUCCESS":
            if seen is not None:
                seen.add(batch_id, mapped)
            state["done"] = batch_id

    return one_batch


def _file_names(spark: SparkSession, path: str, max_files: int | None) -> DataFrame:
    """A stream of the names of the files of a folder; their content is not read."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", int(max_files))
    return reader.format("binaryFile").load(path).select("path")


def start_stream(spark: SparkSession, spec: JobSpec, path: str, schema, fmt: str = "parquet",
                 store: RunStore | None = None, trigger: str = "availableNow",
                 checkpoint_location: str | None = None, max_files_per_trigger: int | None = None,
                 unique: UniqueAcross | None = None) -> StreamingQuery:
    """Start the stream; returns the StreamingQuery (call ``awaitTermination``).

    ``fmt="table"`` streams from a catalog table (``path`` is its name).  ``fmt="csv"`` / ``"tsv"`` streams the names
    of the files, and every batch's files are read by the batch CSV reader with the given schema: the same null
    tokens, quoted line breaks, and the source option ``bad_rows`` (a row that does not parse fails the batch, or is kept as a violation).
    """
    store = store or RunStore.default(spark)
    # the same job and store go on where they stopped
    loc = checkpoint_location or store.path(f"streams/{hashlib.sha1(spec.id.encode()).hexdigest()[:16]}")
    prepare, repeats = None, True
    if fmt == "table":
        reader = spark.readStream
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
        stream, repeats = reader.table(path), None
    elif fmt in ("csv", "tsv"):
        o = dict(spec.source.options)
        stream = _file_names(spark, path, max_files_per_trigger)

        def prepare(names: DataFrame) -> DataFrame | None:
            files = sorted(r["path"] for r in names.collect())  # one batch's files, as the stream lists them
            if not files:
                return None
            return read_csv(names.sparkSession, files, sep=o.get("delimiter") or o.get("sep") or ("\t" if fmt == "tsv" else ","), encoding=o.get("encoding", "UTF-8"),
                            schema=schema, multi_line=o.get("multiLine"), bad_rows=str(o.get("bad_rows", "fail")).lower())
    else:
        reader = spark.readStream
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
        stream = reader.schema(schema).format(fmt).load(path)
    w = (stream.writeStream.foreachBatch(batch_runner(spec, store, stream_key(spec, loc), prepare, repeats, unique))
         .option("checkpointLocation", loc))
    if trigger == "availableNow":
        w = w.trigger(availableNow=True)
    else:
        w = w.trigger(processingTime=trigger)
    return w.start()
