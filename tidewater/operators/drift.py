"""Schema drift: compare a frame with the expected schema.

Reports one row per difference: ``added`` (in the data, not expected),
``removed`` (expected, missing), ``type_changed`` and ``nullability`` (an
expected NOT NULL column that holds NULLs).  The nullability check is one
aggregate over the data (``count_if(col is null)`` per such column), which a run puts
into the observation of its source (:func:`null_checks`); the rest is schema-only.  Action WARN logs, STOP raises, IGNORE skips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.errors import JobError

DRIFT_SCHEMA = "column string, change string, expected string, actual string, null_count bigint"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_struct(schema) -> T.StructType:
    if isinstance(schema, T.StructType):
        return schema
    return T.DataType.fromDDL(schema)


def _strict(df: DataFrame, expected) -> list[str]:
    """Columns of the frame that may hold no NULL."""
    return [f.name for f in as_struct(expected).fields if not f.nullable and f.name in df.columns]


def drift_rows(df: DataFrame, expected, data: bool = True) -> list[tuple]:
    """One row for each difference; ``data=False`` leaves out what only the rows can tell (NULLs)."""
    exp = as_struct(expected)
    actual = {f.name: f for f in df.schema.fields}
    want = {f.name: f for f in exp.fields}
    rows: list[tuple] = []
    for f in exp.fields:
        a = actual.get(f.name)
        if a is None:
            rows.append((f.name, "removed", f.dataType.simpleString(), None, None))
        elif a.dataType != f.dataType:
            rows.append((f.name, "type_changed", f.dataType.simpleString(), a.dataType.simpleString(), None))
    for f in df.schema.fields:
        if f.name not in want:
            rows.append((f.name, "added", None, f.dataType.simpleString(), None))
    strict = _strict(df, exp) if data else []
    if strict:
        counts = df.agg(*[F.count_if(F.col(_q(c)).isNull()).alias(c) for c in strict]).collect()[0]
        for c in strict:
            n = int(counts[c] or 0)
            if n:
                rows.append((c, "nullability", "not null", "null", n))
    return rows


NULL_COUNT = "__null_count_"


def null_checks(df: DataFrame, expected, action: str) -> list:
    """Counts of NULLs in columns that may hold none, for an observation of a pass that is made anyway."""
    if expected is None or action.upper() == "IGNORE":
        return []
    return [F.count_if(F.col(_q(c)).isNull()).alias(NULL_COUNT + c) for c in _strict(df, expected)]


def drift_texts(expected, action: str, seen: dict) -> list[str]:
    """Warnings for the counts of :func:`null_checks`, or the error of the action STOP."""
    rows = [(k[len(NULL_COUNT):], "nullability", "not null", "null", int(n)) for k, n in seen.items() if k.startswith(NULL_COUNT) and n]
    return _act(rows, action)


def schema_drift(spark: SparkSession, df: DataFrame, expected) -> DataFrame:
    """The drift report as a DataFrame."""
    return spark.createDataFrame(drift_rows(df, expected), DRIFT_SCHEMA)


def check_drift(df: DataFrame, expected, action: str = "WARN", data: bool = True) -> list[str]:
    """Apply the drift action; return warning texts (WARN) or raise (STOP)."""
    if action.upper() == "IGNORE" or expected is None:
        return []
    return _act(drift_rows(df, expected, data), action)


def _act(rows: list[tuple], action: str) -> list[str]:
    texts = [f"schema drift: {c} {ch} (expected {e}, actual {a})" for c, ch, e, a, _ in rows]
    if rows and action.upper() == "STOP":
        raise JobError("SCHEMA_DRIFT", "schema drift detected", "; ".join(texts))
    return texts
