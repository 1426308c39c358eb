"""How new files become part of a path target: staged, committed by one rename, then moved in.

1. The new files are written to a sibling, ``<target>.__staging-<tag>``; nothing sees them.
2. A plan file in it says what the change is: the files of the target that it
   replaces (or all), and the *receipt* of the load.
3. One rename to ``<target>.__commit-<tag>`` commits the change, receipt included.
4. The files are moved into the target and the replaced ones are deleted; where all are
   replaced, the folder itself takes the target's place.

A driver may be lost at any point.  Before step 3 the target is as it was; after it, readers
of this library (:func:`load_live`) see the new rows whatever is left to do, and the next writer
does it (:func:`settle`; every step can be repeated).  Between loads the target is a
plain folder of files for any other reader.  One writer for each target at a time is
assumed; a rename must be atomic, as on HDFS and local file systems.

A *receipt* is what the last load of a job into this target leaves behind, in ``<target>/_loads``:
its run, the rows, and the high-water marks before and after.  It is committed with the rows, so
a run that was lost between its load and its record is recognised.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import time
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from tidewater.errors import JobError

PLAN = "_plan.json"
LOADS = "_loads"
#: where a driver can be lost, in order
STEPS = ("staged", "committed", "moving", "moved")
#: seconds after which a staging folder without a commit belongs to no one
ABANDONED = 7 * 24 * 3600

_AT: ContextVar[Callable[[str], None] | None] = ContextVar("tidewater_publish_step", default=None)


class DriverLost(RuntimeError):
    """Raised by :func:`lost_at` in place of a driver's end."""


@contextlib.contextmanager
def lost_at(step: str):
    """Rehearse a driver's loss: the next publication inside the block ends at ``step``."""
    def fail(now):
        if now == step:
            raise DriverLost(step)
    token = _AT.set(fail)
    try:
        yield
    finally:
        _AT.reset(token)


def _at(step: str) -> None:
    hook = _AT.get()
    if hook is not None:
        hook(step)


# -- files -----------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _read(fs, p) -> dict:
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _write(fs, p, value: dict) -> None:
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()


def data_files(spark: SparkSession, root: str) -> list[str]:
    """Relative paths of the files that Spark reads below ``root``."""
    fs, p = _fs(spark, root)
    base = fs.makeQualified(p).toUri().getPath()
    out, stack = [], [p]
    while stack:
        for st in fs.listStatus(stack.pop()):
            name = st.getPath().getName()
            if st.isDirectory():
                if not name.startswith(".") and (not name.startswith("_") or "=" in name):
                    stack.append(st.getPath())
            elif not name.startswith(("_", ".")):
                out.append(st.getPath().toUri().getPath()[len(base):].lstrip("/"))
    return sorted(out)


def staging_path(root: str) -> str:
    return f"{root.rstrip('/')}.__staging-{uuid.uuid4().hex[:12]}"


def _commits(spark: SparkSession, root: str) -> list:
    fs, p = _fs(spark, root.rstrip("/"))
    return sorted((st.getPath() for st in fs.globStatus(_path(spark, f"{root.rstrip('/')}.__commit-*")) or [] if st.isDirectory()), key=str)


# -- writing ---------------------------------------------------------------------------------------


def publish(spark: SparkSession, root: str, staging: str, replace: bool = False, removes: list[str] | tuple = (), receipt: dict | None = None) -> None:
    """Make the files below ``staging`` part of ``root``, in place of all files or of ``removes`` (relative paths)."""
    root = root.rstrip("/")
    fs, staged = _fs(spark, staging)
    _at("staged")
    _write(fs, _path(spark, f"{staging}/{PLAN}"), {"replace": replace, "removes": list(removes), "receipt": receipt})
    commit = _path(spark, f"{root}.__commit-{staging.rsplit('-', 1)[-1]}")
    if not fs.rename(staged, commit):
        raise JobError("WRITE_FAILED", f"rename {staging} failed")
    _at("committed")
    _apply(spark, root, commit)


def _apply(spark: SparkSession, root: str, commit) -> None:
    fs, target = _fs(spark, root)
    plan_path = _path(spark, f"{commit.toString()}/{PLAN}")
    if not fs.exists(plan_path):  # all but its deletion was done before
        fs.delete(commit, True)
        return
    plan = _read(fs, plan_path)
    if plan["replace"]:
        if plan["receipt"]:
            _keep_receipt(spark, commit.toString(), plan["receipt"])
        if fs.exists(target):
            retired = _path(spark, f"{root}.__retiredall-{commit.getName().rsplit('-', 1)[-1]}")
            _move(fs, target, retired)
            _at("moving")
        _move(fs, commit, target)
        _at("moved")
        fs.delete(_path(spark, f"{root}/{PLAN}"), False)
        for st in fs.globStatus(_path(spark, f"{root}.__retiredall-*")) or []:
            fs.delete(st.getPath(), True)
        return
    fs.mkdirs(target)
    for n, rel in enumerate(data_files(spark, commit.toString())):
        dst = _path(spark, f"{root}/{rel}")
        fs.mkdirs(dst.getParent())
        _move(fs, _path(spark, f"{commit.toString()}/{rel}"), dst)
        if not n:
            _at("moving")
    for rel in plan["removes"]:
        fs.delete(_path(spark, f"{root}/{rel}"), False)
    if plan["receipt"]:
        _keep_receipt(spark, root, plan["receipt"])
    _at("moved")
    fs.delete(plan_path, False)
    fs.delete(commit, True)


def _move(fs, src, dst) -> None:
    if fs.exists(src) and not fs.rename(src, dst) and fs.exists(src):
        raise JobError("WRITE_FAILED", f"rename {src} -> {dst} failed")


def settle(spark: SparkSession, root: str) -> list[str]:
    """Finish what a lost driver has committed, and remove staging folders that no one has touched for ``ABANDONED``
    seconds; called by writers.  Returns the commits finished."""
    root = root.rstrip("/")
    fs, p = _fs(spark, root)
    if p.getParent() is None or not fs.exists(p.getParent()):
        return []
    done = []
    for commit in _commits(spark, root):
        _apply(spark, root, commit)
        done.append(commit.getName())
    for st in fs.globStatus(_path(spark, f"{root}.__staging-*")) or []:
        if st.getModificationTime() / 1000 < time.time() - ABANDONED:
            fs.delete(st.getPath(), True)
    return done


# -- reading ---------------------------------------------------------------------------------------


def exists(spark: SparkSession, root: str) -> bool:
    fs, p = _fs(spark, root)
    return bool(fs.exists(p)) or bool(_commits(spark, root))


def load_live(spark: SparkSession, root: str, load: Callable[[list[str], str], DataFrame]) -> DataFrame:
    """The rows of ``root`` with everything that is committed, moved in or not; nothing is changed.

    ``load(paths, base)`` reads files or a folder whose partition folders begin below ``base``.
    """
    root = root.rstrip("/")
    commits = _commits(spark, root)
    if not commits:
        return load([root], root)
    fs, p = _fs(spark, root)
    parts = {root: [f"{root}/{f}" for f in data_files(spark, root)] if fs.exists(p) else []}
    for commit in commits:
        plan_path = _path(spark, f"{commit.toString()}/{PLAN}")
        if not fs.exists(plan_path):
            continue
        plan = _read(fs, plan_path)
        if plan["replace"]:
            parts = {}
        gone = {f"{root}/{r}" for r in plan["removes"]}
        parts = {base: [f for f in files if f not in gone] for base, files in parts.items()}
        parts[commit.toString()] = [f"{commit.toString()}/{f}" for f in data_files(spark, commit.toString())]
    frames = [load(files, base) for base, files in parts.items() if files]
    if not frames:
        return load([root], root)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# -- receipts --------------------------------------------------------------------------------------


def _receipt_path(spark: SparkSession, root: str, job: str):
    return _path(spark, f"{root.rstrip('/')}/{LOADS}/{hashlib.sha1(job.encode()).hexdigest()[:16]}.json")


def _keep_receipt(spark: SparkSession, root: str, receipt: dict) -> None:
    p = _receipt_path(spark, root, receipt["job"])
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    _write(fs, p, receipt)


def receipt_of(spark: SparkSession, root: str, job: str) -> dict | None:
    """The receipt of the job's last load into ``root`` (whatever was committed counts)."""
    fs, _ = _fs(spark, root)
    for commit in reversed(_commits(spark, root)):
        plan_path = _path(spark, f"{commit.toString()}/{PLAN}")
        if fs.exists(plan_path):
            plan = _read(fs, plan_path)
            if plan["receipt"] and plan["receipt"]["job"] == job:
                return plan["receipt"]
            if plan["replace"]:
                return None
    p = _receipt_path(spark, root, job)
    try:
        return _read(fs, p) if fs.exists(p) else None
    except ValueError:  # cut off while it was written: its commit is still there, or a later load will replace it
        return None
