"""Sinks and the six load strategies.

APPEND / INCREMENTAL   append, aligned by name to an existing target.
FULL_LOAD / TRUNCATE_INSERT   replace the rows, keep the target's schema.
OVERWRITE   replace rows *and* schema.
UPSERT   merge on keys (:mod:`tidewater.operators.merge`).

Path targets (Parquet / ORC / CSV / JSON) take every change by
:mod:`tidewater.sources.publish`: new files are staged, committed by one rename and
moved in, so a plan may read the target it changes, a failed write leaves
the old rows, and a lost driver leaves the old rows or the new ones.  An UPSERT into Parquet or
ORC rewrites only the files that hold a key of the source (:func:`touched_files`); a
partitioned one whose partition columns are keys looks for them only in the partitions touched.
Catalog tables use ``insertInto``, from a frame
first written to the shared checkpoint folder when the plan reads the table it
overwrites.  The row count comes from an ``Observation`` on the written frame —
no second pass.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.errors import JobError
from tidewater.fixed import ERROR_MESSAGES, LOAD_STRATEGIES
from tidewater.operators.merge import MergeSource, align_to_schema, plan_upsert, prepare_source, split_source
from tidewater.plans.observed import Probe
from tidewater.session import ensure_checkpoint_dir, materialize, rebalance_for_write
from tidewater.sources import publish
from tidewater.spec import TargetSpec

PATH_KINDS = ("parquet", "orc", "csv", "json")
#: kinds whose files an UPSERT replaces one by one
FILE_MERGE_KINDS = ("parquet", "orc")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class WriteResult:
    rows_written: int
    rows_skipped: int = 0
    observed: dict | None = None
    connect_ms: int = 0
    files_replaced: int | None = None  # UPSERT by files: how many were rewritten


# ---------------------------------------------------------------------------
# file-system helpers (Hadoop FS through the session, works for any scheme)
# ---------------------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def _rename(spark: SparkSession, src: str, dst: str) -> None:
    fs, s = _fs(spark, src)
    _, d = _fs(spark, dst)
    if not fs.rename(s, d):
        raise JobError("WRITE_FAILED", f"rename {src} -> {dst} failed")


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def table_exists(spark: SparkSession, name: str) -> bool:
    return bool(spark.catalog.tableExists(name))


def reads_table(df: DataFrame, name: str) -> bool:
    """Whether ``df``'s plan reads the catalog table ``name`` (then it must be
    materialised before the table is overwritten)."""
    plan = df._jdf.queryExecution().analyzed().toString().lower()
    short = name.lower().split(".")[-1]
    return f".{short}" in plan or f" {short}" in plan


# ---------------------------------------------------------------------------
# reading the current target
# ---------------------------------------------------------------------------

def _writer(df: DataFrame, target: TargetSpec, mode: str):
    w = df.write.mode(mode)
    opts = dict(target.options)
    if target.kind == "csv":
        from tidewater.sources.readers import enable_charset
        enable_charset(df.sparkSession, opts.get("encoding"))
        sep = opts.pop("sep", ",")
        # values come back as they are: quotes doubled, no white space trimmed
        w = (w.option("header", "true").option("sep", opts.pop("delimiter", sep)).option("escape", '"')
             .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false"))
    for k, v in opts.items():
        w = w.option(k, str(v))
    if target.partition_by:
        w = w.partitionBy(*target.partition_by)
    return w


def _typed_partitions(spark: SparkSession, target: TargetSpec, like: T.StructType | None) -> Callable[[list[str], str], DataFrame]:
    """A loader of the target's files, partition columns in the types of the frame to be
    written (text if it lacks them): folder names alone would make ``'01'`` an integer."""
    def load(paths: list[str], base: str) -> DataFrame:
        reader = spark.read.format(target.kind)
        if target.evolve == "add":  # files of different ages may differ in columns
            reader = reader.option("mergeSchema", "true")
        if paths != [base]:
            reader = reader.option("basePath", base)
        if not target.partition_by:
            return reader.load(paths)
        have = {f.name: f.dataType for f in like.fields} if like is not None else {}
        fields = [T.StructField(f.name, have.get(f.name, T.StringType() if like is not None else f.dataType), True)
                  if f.name in target.partition_by else f for f in reader.load(paths).schema.fields]
        return reader.schema(T.StructType(fields)).load(paths)
    return load


def _evolved(spark: SparkSession, current: DataFrame, incoming: DataFrame, target: TargetSpec, ignore: str | None) -> DataFrame:
    """``current`` with the columns of ``incoming`` that it lacks, NULL in its rows; a catalog table gains them."""
    new = [f for f in incoming.schema.fields if f.name not in current.columns and f.name != ignore]
    if not new:
        return current
    if target.kind.lower() == "table":
        spark.sql(f"ALTER TABLE {target.table} ADD COLUMNS ({', '.join(f'{_q(f.name)} {f.dataType.simpleString()}' for f in new)})")
        return spark.read.table(target.table)
    return current.withColumns({f.name: F.lit(None).cast(f.dataType) for f in new})


_NO_TABLE = re.compile(r"does(n't| not) exist|not exist|invalid object name|no such table|42S02|42P01|unknown table", re.I)


def read_target(spark: SparkSession, target: TargetSpec, like: T.StructType | None = None) -> DataFrame | None:
    """The current target rows, or None when it does not exist yet.

    ``like`` is the schema of the frame to be written.  A CSV target is read as
    the text it holds."""
    kind = target.kind.lower()
    if kind in PATH_KINDS:
        if not publish.exists(spark, target.path):
            return None
        try:
            if kind == "csv":
                from tidewater.sources.readers import read_csv
                return publish.load_live(spark, target.path, lambda paths, base: read_csv(
                    spark, paths, sep=target.options.get("delimiter", target.options.get("sep", ",")),
                    encoding=target.options.get("encoding", "UTF-8"), null_tokens=(), infer=False, multi_line=True))
            return publish.load_live(spark, target.path, _typed_partitions(spark, target, like))
        except AnalysisException as e:  # folder without data files (e.g. a failed first write)
            if (e.getCondition() or "") != "UNABLE_TO_INFER_SCHEMA" and "EMPTY_SCHEMA" not in str(e):
                raise
            return None
    if kind == "table":
        return spark.read.table(target.table) if table_exists(spark, target.table) else None
    if kind == "jdbc":
        from tidewater.sources.readers import read_jdbc
        o = dict(target.options)
        try:  # resolving the schema fails when the table does not exist
            return read_jdbc(spark, url=o.pop("url"), table=target.table, user=o.pop("user", None),
                             password=o.pop("password", None), driver=o.pop("driver", None))
        except Exception as e:  # noqa: BLE001 - only a missing table is "no target"; any other error must not end in an overwrite
            if _NO_TABLE.search(str(e)):
                return None
            raise
    raise JobError("SPEC_INVALID", f"unknown target kind {target.kind!r}")


# ---------------------------------------------------------------------------
# physical writes
# ---------------------------------------------------------------------------

def _staged(spark: SparkSession, df: DataFrame, target: TargetSpec) -> str:
    """Write ``df`` to a staging folder beside the target."""
    staging = publish.staging_path(target.path)
    _writer(df, target, "overwrite").format(target.kind).save(staging)
    return staging


def _staged_replace(spark: SparkSession, df: DataFrame, target: TargetSpec) -> None:
    """Write ``df`` and put it in the target's place."""
    publish.publish(spark, target.path, _staged(spark, df, target), replace=True)


def _partition_dirs(spark: SparkSession, root: str, depth: int) -> list[str]:
    """Relative leaf partition directories (``a=1/b=2``) below ``root``."""
    fs, p = _fs(spark, root)
    level = [("", p)]
    for _ in range(depth):
        nxt = []
        for rel, path in level:
            for st in fs.listStatus(path):
                name = st.getPath().getName()
                if st.isDirectory() and "=" in name and not name.startswith("."):
                    nxt.append((f"{rel}/{name}" if rel else name, st.getPath()))
        level = nxt
    return [rel for rel, _ in level]


def touched_files(spark: SparkSession, current: DataFrame, target: TargetSpec, source: MergeSource, keys: list[str]) -> list[str]:
    """Relative paths of the target's files that hold a key of the source.

    Reads the key columns only.  The range of each key goes to the scan, so that files (and row groups)
    outside it are skipped by their statistics; the rest is a semi-join, with the source's keys broadcast where they were
    measured to be small.  One row for each touched file reaches the driver, which lists the target's files anyway.
    """
    fields = {f.name: f.dataType for f in current.schema.fields}
    ordered = [k for k in keys if isinstance(fields[k], (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.DecimalType))]
    mine = source.keyed.select(*[F.col(_q(k)) for k in keys])
    scan = current.select(*[F.col(_q(k)) for k in keys], F.col("_metadata.file_path").alias("__file"))
    if ordered:
        ends = mine.agg(*[f(F.col(_q(k))).alias(f"{n}{i}") for i, k in enumerate(ordered) for n, f in (("a", F.min), ("b", F.max))]).first()
        for i, k in enumerate(ordered):
            if ends[f"a{i}"] is None:  # no key at all
                return []
            low, high = (F.lit(ends[f"{n}{i}"]).cast(fields[k]) for n in "ab")
            scan = scan.where((F.col(_q(k)) >= low) & (F.col(_q(k)) <= high))
    mine = F.broadcast(mine) if source.small else mine
    found = scan.join(mine, keys, "left_semi").select("__file").distinct().collect()
    fs, p = _fs(spark, target.path)
    base = fs.makeQualified(p).toUri().getPath().rstrip("/")
    out = []
    for r in found:
        full = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(unquote(r["__file"])).toUri().getPath()
        out.append(full[len(base):].lstrip("/"))
    return sorted(out)


def _upsert_by_files(spark: SparkSession, current: DataFrame, incoming: DataFrame, target: TargetSpec, keys: list[str],
                     order_by: str | None) -> tuple[DataFrame, list[DataFrame], list[str]]:
    """(rows of the new files, frames executed while planning, files that they replace)."""
    source = prepare_source(current.schema, incoming, keys, order_by)
    touched = touched_files(spark, current, target, source, keys)
    if touched:
        held = (spark.read.format(target.kind).schema(current.schema).option("basePath", target.path)
                .load([f"{target.path.rstrip('/')}/{f}" for f in touched]))
    else:
        held = spark.createDataFrame([], current.schema)
    out, ran = plan_upsert(held, incoming, keys, order_by, target.defaults, source_ready=source)
    return out, ran, touched


def recover_swaps(spark: SparkSession, path: str) -> list[str]:
    """Undo a swap by renames, as earlier versions did it, that a lost driver left half done.

    A whole swap renames ``target -> target.__retiredall-<tag>`` and then ``staging
    -> target``: the retired rows are the target only while there is none.  A
    partition swap moves single partition folders to ``target.__retired-<tag>``
    and a new one into each one's place: a retired folder goes back only where
    its place is empty.  Returns the restored paths.
    """
    root = path.rstrip("/")
    fs, p = _fs(spark, root)
    parent = p.getParent()
    if parent is None or not fs.exists(parent):
        return []
    restored = []
    jvm = spark.sparkContext._jvm
    whole = [st.getPath() for st in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}.__retiredall-*")) or [] if st.isDirectory()]
    for retired in whole:
        if not fs.exists(p):
            if fs.rename(retired, p):
                restored.append(root)
        else:
            fs.delete(retired, True)  # the new rows are in place
    parts = [st.getPath() for st in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}.__retired-*")) or [] if st.isDirectory()]
    for retired in parts:
        if not fs.exists(p):
            if fs.rename(retired, p):
                restored.append(root)
            continue
        stack = [("", retired)]
        while stack:
            rel, cur = stack.pop()
            for child in fs.listStatus(cur):
                cname = child.getPath().getName()
                if not child.isDirectory() or "=" not in cname:
                    continue
                crel = f"{rel}/{cname}" if rel else cname
                dst = jvm.org.apache.hadoop.fs.Path(f"{root}/{crel}")
                if fs.exists(dst):
                    stack.append((crel, child.getPath()))
                else:
                    fs.mkdirs(dst.getParent())
                    if fs.rename(child.getPath(), dst):
                        restored.append(f"{root}/{crel}")
        fs.delete(retired, True)
    return restored


def compact_target(spark: SparkSession, target: TargetSpec, file_bytes: int = 128 * 1024 * 1024) -> int:
    """Rewrite the files of a path target that are smaller than half of ``file_bytes`` into files of about that size, folder
    by folder, in one commit; the others stay.  Loads by touched files and appends leave small files behind.

    Returns the number of files replaced.
    """
    if target.kind.lower() not in FILE_MERGE_KINDS:
        raise JobError("SPEC_INVALID", f"a {target.kind} target is not compacted")
    publish.settle(spark, target.path)
    root = target.path.rstrip("/")
    if not path_exists(spark, root):
        return 0
    fs, _ = _fs(spark, root)
    folders: dict[str, list[tuple[str, int]]] = {}
    for f in publish.data_files(spark, root):
        size = int(fs.getFileStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{f}")).getLen())
        if size * 2 < file_bytes:
            folders.setdefault(f.rpartition("/")[0], []).append((f, size))
    small = {k: v for k, v in folders.items() if len(v) > 1}
    files = [f for v in small.values() for f, _ in v]
    if not files:
        return 0
    found = _typed_partitions(spark, target, None)([root], root).schema
    # folder names as they are written: '01' is no number here
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in target.partition_by else f for f in found.fields])
    rows = spark.read.format(target.kind).schema(schema).option("basePath", root).load([f"{root}/{f}" for f in files])
    if target.partition_by:  # sized by bytes; a folder of many is split
        rows = rows.hint("rebalance", *[F.col(_q(c)) for c in target.partition_by])
    else:
        rows = rows.coalesce(max(1, -(-sum(n for v in small.values() for _, n in v) // file_bytes)))
    publish.publish(spark, root, _staged(spark, rows, target), removes=files)
    return len(files)


def _jdbc_options(target: TargetSpec, batch_size: int) -> dict[str, str]:
    o = {k: str(v) for k, v in target.options.items()}
    o["dbtable"] = target.table
    o.setdefault("batchsize", str(batch_size))
    return o


def write_frame(spark: SparkSession, df: DataFrame, target: TargetSpec, strategy: str,
                upsert_keys=(), order_by: str | None = None, batch_size: int = 10000,
                observe_exprs: list | None = None, receipt: Callable[[dict], dict | None] | None = None) -> WriteResult:
    """Load ``df`` into ``target`` with one of the six strategies.

    ``receipt`` turns what was observed into the load's receipt, which a path target gets in the same commit."""
    strategy = strategy.upper()
    if strategy not in LOAD_STRATEGIES:
        raise JobError("SPEC_INVALID", f"unknown load strategy {strategy!r}")
    kind = target.kind.lower()
    ensure_checkpoint_dir(spark)
    if kind in PATH_KINDS:
        publish.settle(spark, target.path)
        recover_swaps(spark, target.path)
    began = time.monotonic()
    current = read_target(spark, target, df.schema)
    connect_ms = int((time.monotonic() - began) * 1000)
    if current is None and not target.create_if_not_exists:
        raise JobError("TABLE_NOT_FOUND", f"target {target.table or target.path} does not exist")

    if target.evolve == "add" and current is not None and strategy != "OVERWRITE":
        if kind not in ("parquet", "orc", "table"):
            raise JobError("SPEC_INVALID", f"a {kind} target cannot gain columns")
        current = _evolved(spark, current, df, target, order_by if strategy == "UPSERT" else None)

    # 1. the frame to write; the Observation counts the incoming rows as
    #    they stream into the write (for UPSERT: the source side of the merge)
    # (an UPSERT's source is written while planning, so planning can fail as a write does)
    probe = Probe("write")
    exprs = [F.count(F.lit(1)).alias("rows")] + list(observe_exprs or [])
    incoming = probe.attach(df, *exprs)
    ran: list[DataFrame] = []  # frames executed while planning (materialised UPSERT source)
    removes: list[str] | None = None  # files that the new ones replace
    scoped = (strategy == "UPSERT" and current is not None and kind in PATH_KINDS and target.partition_by
              and set(target.partition_by) <= set(upsert_keys))
    try:
        if strategy == "UPSERT":
            if current is None:
                # NULL keys match nothing, on the first load as later
                keyed, null_keys = split_source(incoming, list(upsert_keys), order_by)
                out = keyed.unionByName(null_keys)
            elif scoped:
                # Only partitions the source touches are read, merged and replaced.
                # The partition columns are part of the key, so no row can move
                # between partitions; the touched set (one row per partition) is
                # semi-joined, which lets dynamic partition pruning skip the rest.
                # Whole partitions are replaced, which keeps their files few.
                parts = list(target.partition_by)
                touched = df.select(*[F.col(_q(c)).alias(f"__p_{c}") for c in parts]).distinct()
                same = reduce(lambda a, b: a & b, [current[_q(c)].eqNullSafe(touched[_q(f"__p_{c}")]) for c in parts])
                current_part = current.join(touched, same, "left_semi")
                out, ran = plan_upsert(current_part, incoming, list(upsert_keys), order_by, target.defaults, plan="auto")
            elif kind in FILE_MERGE_KINDS:
                out, ran, removes = _upsert_by_files(spark, current, incoming, target, list(upsert_keys), order_by)
            else:
                out, ran = plan_upsert(current, incoming, list(upsert_keys), order_by, target.defaults, plan="auto")
        elif strategy == "OVERWRITE" or current is None:
            out = incoming
        else:
            # a CSV target has text only, whatever is written
            out = align_to_schema(incoming, current.schema, target.defaults, cast=kind != "csv")
    except (JobError, AnalysisException):
        raise
    except Exception as e:  # noqa: BLE001
        raise JobError("WRITE_FAILED", ERROR_MESSAGES["WRITE_FAILED"].format(what=target.table or target.path), str(e))

    # 2. write.  Partitioned path targets written from many tasks are
    # rebalanced on the partition columns first (AQE sizes the files and
    # splits a partition holding a third of the rows), instead of every task
    # writing a file into every partition it touches.
    if target.partition_by and kind in PATH_KINDS:
        out = rebalance_for_write(out, *target.partition_by)
    replace = strategy in ("FULL_LOAD", "TRUNCATE_INSERT", "OVERWRITE", "UPSERT")
    try:
        if kind in PATH_KINDS:
            staging = _staged(spark, out, target)
            got = probe.result(out, *ran)  # {} when the incoming rows were provably empty
            if scoped:
                dirs = tuple(f"{rel}/" for rel in _partition_dirs(spark, staging, len(target.partition_by)))
                removes = [f for f in publish.data_files(spark, target.path) if f.startswith(dirs)] if dirs else []
            try:
                slip = receipt(dict(got)) if receipt else None
            except Exception:
                _delete(spark, staging)  # the load was called off
                raise
            publish.publish(spark, target.path, staging, replace=replace and removes is None, removes=removes or (), receipt=slip)
        elif kind == "table":
            # a plan that reads the table it overwrites is cut on the shared
            # checkpoint folder first; others are written directly
            safe = materialize(out, "table-replace") if current is not None and replace and \
                reads_table(out, target.table) else out
            if current is None or strategy == "OVERWRITE":
                _writer(safe, target, "overwrite").saveAsTable(target.table)
            elif replace:
                safe.write.insertInto(target.table, overwrite=True)
            else:
                out.write.insertInto(target.table)
        elif kind == "jdbc":
            o = _jdbc_options(target, batch_size)
            if replace:
                o["truncate"] = "true"
                frame = materialize(out, "jdbc-replace") if strategy == "UPSERT" else out
                frame.write.format("jdbc").options(**o).mode("overwrite").save()
            else:
                out.write.format("jdbc").options(**o).mode("append").save()
        else:
            raise JobError("SPEC_INVALID", f"unknown target kind {target.kind!r}")
    except (JobError, publish.DriverLost):
        raise
    except Exception as e:  # noqa: BLE001
        from tidewater.sources.readers import is_connection_error
        code = "TARGET_CONNECTION_FAILED" if kind == "jdbc" and is_connection_error(e) else "WRITE_FAILED"
        raise JobError(code, ERROR_MESSAGES["WRITE_FAILED"].format(what=target.table or target.path), str(e))
    if kind not in PATH_KINDS:
        got = probe.result(out, *ran)
    return WriteResult(rows_written=int(got.get("rows", 0) or 0), observed=dict(got), connect_ms=connect_ms,
                       files_replaced=None if scoped or removes is None else len(removes))
