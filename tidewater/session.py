"""Session helpers: recommended settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (timestamps are naive), ANSI
# casts (``try_cast`` is used wherever the reference turns failures into
# nulls), strict date parsing, and AQE for runtime re-planning (partition
# coalescing, skew-join splitting, runtime broadcast of small shuffle sides).
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.legacy.timeParserPolicy": "CORRECTED",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = "local[*]", app: str = "tidewater",
                  shuffle_partitions: int | None = 8, extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the recommended settings.

    ``master=None`` / ``shuffle_partitions=None`` leave those to spark-submit
    and the cluster's configuration (as the CLI does unless told otherwise);
    the defaults are for tests, the benchmark and local use.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(RECOMMENDED_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf["spark.ui.enabled"] = "false"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# The subset applied to a session handed in by a caller (the driver's own
# session): only what results depend on, nothing that changes how the caller
# collects or writes its own data.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.legacy.timeParserPolicy": "CORRECTED",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def sizing_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 200 * 1024 * 1024) -> dict:
    """Settings that keep shuffle and scan partitions near
    ``target_partition_bytes`` for an input of ``input_bytes``.

    At 100 TB on 1000 executors x 8 cores this gives ~524k initial shuffle
    partitions (AQE coalesces small ones at run time), 256 MB scan splits and
    skew splitting above 1 GB; at sf0.1 it stays at a few tasks per core.
    """
    shuffle = max(2 * total_cores, -(-int(input_bytes) // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024 if input_bytes > (1 << 40) else 128 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(max(256 * 1024 * 1024,
                                                                               5 * target_partition_bytes)),
    }


def apply_recommended_conf(spark: SparkSession) -> None:
    """Set the settings results depend on, on an existing session."""
    for k, v in SEMANTIC_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running session: keep the cluster's value
            pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only when nothing is configured and the
    master is local (tests) a private folder is created and registered; on a
    cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", str(sc.master)):
            # a machine-local folder is not visible to the executors of a cluster
            from tidewater.errors import JobError
            raise JobError("SPEC_INVALID", "set spark.checkpoint.dir to a folder shared by the cluster "
                                           "(HDFS / object store); it holds materialised intermediates")
        conf_dir = tempfile.mkdtemp(prefix="tidewater-ckpt-")  # local mode only (tests)
    sc.setCheckpointDir(conf_dir)
    return (sc.getCheckpointDir() or conf_dir).rstrip("/")


# folders of the run that is going on in this thread (runs in other threads have their own)
_SCOPE: ContextVar[list[str] | None] = ContextVar("tidewater_scratch", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused folder below the shared checkpoint folder.

    Inside :func:`scratch_scope` the folder is removed when the scope ends.
    """
    base = ensure_checkpoint_dir(spark)
    path = f"{base}/tidewater-scratch/{name}-{uuid.uuid4().hex[:12]}"
    owned = _SCOPE.get()
    if owned is not None:
        owned.append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Remove the intermediate folders created inside the block (materialised
    duplicate keys, UPSERT sources) once it is done; used around a run, whose
    outputs are all written by then."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            try:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
            except Exception:  # noqa: BLE001 - best effort; the folder is scratch
                pass


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme (used only by local-file helpers in tests)."""
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)


def materialize(df, name: str):
    """Write ``df`` as Parquet below the shared checkpoint folder and return
    the frame read back.

    Cuts the lineage (a lost executor cannot force a recomputation of what
    produced it), is computed once however often it is read, and gives the
    planner the real on-disk size, so a broadcast of it is decided on a
    measured size rather than an estimate.
    """
    return materialize_sized(df, name)[0]


def materialize_sized(df, name: str):
    """:func:`materialize`, plus the written size in bytes (measured on the
    file system, so a broadcast decision can rest on it)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return spark.read.parquet(path), int(size)


def row_bytes(schema):
    """Column of a row's bytes in memory, uncompressed: text by its length, nested values by their JSON length, the
    rest by the width of its type."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    fixed = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    width, lengths = 16, []  # 16: a row's own overhead
    for f in schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        width += fixed.get(type(f.dataType), 8)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            lengths.append(F.octet_length(c))
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            lengths.append(F.octet_length(F.to_json(F.struct(c.alias("v")))))
    each = F.lit(width).cast("long")
    for n in lengths:
        each = each + F.coalesce(n, F.lit(0))
    return each


def memory_bytes(df) -> int:
    """Bytes of ``df``'s values in memory; one aggregate, meant for frames just materialised."""
    from pyspark.sql import functions as F
    return int(df.agg(F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0)).alias("b")).first()["b"])


def materialize_measured(df, name: str):
    """:func:`materialize`, plus the size on disk and the size in memory, which the write itself observes."""
    from pyspark.sql import functions as F

    from tidewater.plans.observed import Probe
    probe = Probe("size")
    watched = probe.attach(df, F.sum(row_bytes(df.schema)).alias("b"))
    out, size = materialize_sized(watched, name)
    return out, size, int(probe.result(watched).get("b") or 0)  # nothing observed: the plan was provably empty


def parse_bytes(text) -> int:
    """Spark byte-size strings: ``134217728``, ``134217728b``, ``128m``, ``1g``."""
    t = str(text).strip().lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}
    if t and t[-1] in units:
        return int(float(t[:-1]) * units[t[-1]])
    return int(t)


def rebalance_for_write(df, *cols):
    """Rebalance ``df`` before a file write when it comes from many more tasks
    than the cluster has cores (then each task would write its own small
    file, or one per output partition).  AQE's rebalance sizes the output by
    bytes, coalescing small partitions and splitting skewed ones.  Plans with
    few tasks are written as they are."""
    from pyspark.sql import functions as F
    spark = df.sparkSession
    # the optimizer's size estimate (from file sizes; nothing is executed)
    # divided by the scan split size approximates the number of write tasks
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = parse_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))
    if size // max(split, 1) <= 4 * spark.sparkContext.defaultParallelism:
        return df
    return df.hint("rebalance", *[F.col("`" + c.replace("`", "``") + "`") for c in cols])
