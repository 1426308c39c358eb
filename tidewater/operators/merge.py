"""UPSERT (merge on keys) and target-schema alignment, as DataFrame plans.

Semantics: unmatched target rows are kept; matched rows take the source value
of every non-key column the source has (source NULLs overwrite); target-only
columns keep their value on update and get their default on insert; among
source rows with the same key the last one (by ``order_by``) wins; a source
row with a NULL key never matches and is inserted.

Plan, chosen for skew:

* the "last wins" dedup is an aggregate — ``max(struct(order, row))`` per key —
  which combines map-side, so a key holding a third of the source collapses
  to one row per task before the shuffle (a ``row_number()`` window would sort
  all of them in one task);
* after the dedup both sides hold at most one row per key, so the full outer
  join on the keys has no hot key at all;
* when the deduplicated source is small — measured on disk after writing it
  to the shared checkpoint folder, not estimated — it is broadcast and the
  target streams past it without being shuffled (``plan="auto"``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.errors import JobError
from tidewater.fixed import ERROR_MESSAGES


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def default_column(name: str, t: T.DataType, defaults: dict[str, Any] | None) -> Column:
    """Value of a target column the frame does not carry."""
    d = (defaults or {}).get(name)
    if d is None:
        return F.lit(None).cast(t)
    if isinstance(d, str) and d.upper() in ("NOW()", "CURRENT_TIMESTAMP"):
        return F.current_timestamp().cast(t)
    return F.lit(d).cast(t)


def align_to_schema(df: DataFrame, target: T.StructType, defaults: dict[str, Any] | None = None,
                    cast: bool = False) -> DataFrame:
    """Select ``df`` in the target's column order, by name.

    Absent target columns get their declared default (or NULL); a frame column
    the target does not have is an error.  ``cast=True`` converts to the
    target types as :func:`align_types` does.
    """
    tnames = [f.name for f in target.fields]
    extra = [c for c in df.columns if c not in set(tnames)]
    if extra:
        raise JobError("WRITE_FAILED", f"target has no column(s) {extra}", str(tnames))
    have = set(df.columns)
    cols = []
    for f in target.fields:
        if f.name in have:
            c = F.col(_q(f.name))
            cols.append((strict_cast(c, df.schema[f.name].dataType, f) if cast else c).alias(f.name))
        else:
            cols.append(default_column(f.name, f.dataType, defaults).alias(f.name))
    return df.select(*cols)


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def strict_cast(c: Column, have: T.DataType, target: T.StructField) -> Column:
    """``c`` as the target's type, never turning a value into NULL.

    Kinds that do not convert (text into a number, a struct into anything) are
    refused here; a value outside the target's range fails the write.
    """
    want = target.dataType
    if have == want or isinstance(have, T.NullType):
        return c if have == want else c.cast(want)
    kinds = [(_NUMBERS, _NUMBERS), (_TIMES, _TIMES)]
    simple = isinstance(want, T.StringType) and not isinstance(have, (T.StructType, T.ArrayType, T.MapType, T.BinaryType))
    if not simple and not any(isinstance(have, a) and isinstance(want, b) for a, b in kinds):
        raise JobError("WRITE_FAILED", f"column {target.name}: {have.simpleString()} does not fit the target's {want.simpleString()}")
    out = c.cast(want)
    if simple or not (isinstance(have, _NUMBERS) and isinstance(want, _NUMBERS)):
        return out
    # whatever the session's cast does on overflow, a lost value stops the job
    lost = c.isNotNull() & c.try_cast(want).isNull()
    message = F.concat(F.lit(f"value out of range for {target.name} {want.simpleString()}: "), c.cast("string"))
    return F.when(lost, F.raise_error(message).cast(want)).otherwise(c.try_cast(want))


def align_types(source: DataFrame, target: T.StructType) -> DataFrame:
    """The source's columns, those that the target has in its types (see
    :func:`strict_cast`); keys are compared and inserted in the target's type."""
    want = {f.name: f for f in target.fields}
    return source.select(*[
        (strict_cast(F.col(_q(f.name)), f.dataType, want[f.name]) if f.name in want else F.col(_q(f.name))).alias(f.name)
        for f in source.schema.fields])


def dedup_last(source: DataFrame, keys: list[str], order_by: str | None) -> DataFrame:
    """One row per key: the one with the greatest ``order_by`` value.

    Without ``order_by`` duplicate keys are an error (there is no "last").
    """
    other = [c for c in source.columns if c not in keys]
    if order_by is None:
        dup = (source.groupBy(*[F.col(_q(k)) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
               .where(F.col("n") > 1).limit(1).count())
        if dup:
            raise JobError("SPEC_INVALID", "UPSERT source repeats a key; set order_by to pick the last row")
        return source
    if order_by not in source.columns:
        raise JobError("COLUMN_NOT_FOUND", ERROR_MESSAGES["COLUMN_NOT_FOUND"].format(col=order_by))
    packed = F.struct(F.col(_q(order_by)).alias("__ord"), *[F.col(_q(c)) for c in other]).alias("__row")
    best = source.groupBy(*[F.col(_q(k)) for k in keys]).agg(F.max(packed).alias("__row"))
    return best.select(*[F.col(_q(k)) for k in keys], *[F.col("__row")[c].alias(c) for c in other]) \
               .select(*[F.col(_q(c)) for c in source.columns])


# Broadcast limit for the deduplicated UPSERT source (bytes on disk); the
# session setting overrides it.
BROADCAST_LIMIT_CONF = "spark.tidewater.upsert.broadcastLimitBytes"
DEFAULT_BROADCAST_LIMIT = 128 * 1024 * 1024


def _check_upsert(tcols: list[str], source: DataFrame, keys: list[str], order_by: str | None) -> None:
    if not keys:
        raise JobError("SPEC_INVALID", "UPSERT needs upsert_keys")
    missing = [k for k in keys if k not in tcols or k not in source.columns]
    if missing:
        raise JobError("COLUMN_NOT_FOUND", f"upsert key(s) {missing} missing")
    extra = [c for c in source.columns if c not in tcols and c != order_by]
    if extra:
        raise JobError("WRITE_FAILED", f"target has no column(s) {extra}")


def split_source(source: DataFrame, keys: list[str], order_by: str | None) -> tuple[DataFrame, DataFrame]:
    """(one row per non-NULL key, last one winning; rows with a NULL key)."""
    any_null = None
    for k in keys:
        e = F.col(_q(k)).isNull()
        any_null = e if any_null is None else any_null | e
    return dedup_last(source.where(~any_null), keys, order_by), source.where(any_null)


def _null_key_inserts(null_key_rows: DataFrame, target: DataFrame, order_by, defaults) -> DataFrame:
    drop = [order_by] if order_by and order_by not in target.columns else []
    return align_to_schema(null_key_rows.drop(*drop), target.schema, defaults, cast=True)


def merge_shuffled(target: DataFrame, keyed: DataFrame, null_key_rows: DataFrame, keys: list[str],
                   order_by: str | None = None, defaults: dict[str, Any] | None = None) -> DataFrame:
    """Full outer join on the keys (both sides shuffled; any size)."""
    tcols = target.columns
    ttypes = {f.name: f.dataType for f in target.schema.fields}
    s = keyed.select(*[F.col(_q(c)).alias(f"__s_{c}") for c in keyed.columns], F.lit(True).alias("__s_hit"))
    t = target.select(*[F.col(_q(c)).alias(f"__t_{c}") for c in tcols], F.lit(True).alias("__t_hit"))
    cond = None
    for k in keys:
        e = F.col(f"__t_{k}") == F.col(f"__s_{k}")
        cond = e if cond is None else cond & e
    j = t.join(s, cond, "full_outer")
    s_hit = F.col("__s_hit").isNotNull()
    t_hit = F.col("__t_hit").isNotNull()
    out = []
    for c in tcols:
        if c in keys:
            out.append(F.coalesce(F.col(f"__s_{c}"), F.col(f"__t_{c}")).alias(c))
        elif c in keyed.columns:
            out.append(F.when(s_hit, F.col(f"__s_{c}")).otherwise(F.col(f"__t_{c}")).alias(c))
        else:
            out.append(F.when(t_hit, F.col(f"__t_{c}")).otherwise(default_column(c, ttypes[c], defaults)).alias(c))
    return j.select(*out).unionByName(_null_key_inserts(null_key_rows, target, order_by, defaults))


def merge_broadcast(target: DataFrame, keyed: DataFrame, null_key_rows: DataFrame, keys: list[str],
                    order_by: str | None = None, defaults: dict[str, Any] | None = None) -> DataFrame:
    """For a source whose size was checked: the target streams past a
    broadcast of the source (no shuffle of the target rows).

    * existing rows: ``target LEFT JOIN broadcast(source)`` — updated where
      the key matches, unchanged otherwise;
    * new rows: source keys not among the target's keys, found by a key-only
      semi-join of the target against the broadcast source keys.
    """
    tcols = target.columns
    ttypes = {f.name: f.dataType for f in target.schema.fields}
    s = keyed.select(*[F.col(_q(c)).alias(f"__s_{c}") for c in keyed.columns], F.lit(True).alias("__s_hit"))
    cond = None
    for k in keys:
        e = target[_q(k)] == F.col(f"__s_{k}")
        cond = e if cond is None else cond & e
    j = target.join(F.broadcast(s), cond, "left")
    s_hit = F.col("__s_hit").isNotNull()
    existing = []
    for c in tcols:
        if c in keys or c not in keyed.columns:
            existing.append(target[_q(c)].alias(c))
        else:
            existing.append(F.when(s_hit, F.col(f"__s_{c}")).otherwise(target[_q(c)]).alias(c))
    updated = j.select(*existing)
    src_keys = keyed.select(*[F.col(_q(k)) for k in keys])
    matched = target.select(*[F.col(_q(k)) for k in keys]).join(F.broadcast(src_keys), keys, "left_semi")
    new_rows = keyed.join(matched, keys, "left_anti")
    inserted = align_to_schema(new_rows.drop(*([order_by] if order_by and order_by not in tcols else [])),
                               target.schema, defaults, cast=True)
    return updated.unionByName(inserted).unionByName(_null_key_inserts(null_key_rows, target, order_by, defaults))


@dataclass
class MergeSource:
    """An UPSERT's source, aligned to the target and free of repeated keys."""
    keyed: DataFrame
    null_keys: DataFrame
    small: bool = False  # measured to be within the broadcast limit
    executed: list[DataFrame] = field(default_factory=list)  # frames already run


def prepare_source(schema: T.StructType, source: DataFrame, keys: list[str], order_by: str | None,
                   measure: bool = True, broadcast_limit: int | None = None) -> MergeSource:
    """One alignment for update, insert and NULL-key rows, in any plan.

    ``measure``: the deduplicated rows are written once to the shared checkpoint folder, which also gives their size; at
    most ``broadcast_limit`` bytes (session setting ``spark.tidewater.upsert.broadcastLimitBytes``, default 128 MB)
    in files and in memory count as small.
    """
    spark = source.sparkSession
    tcols = [f.name for f in schema.fields]
    _check_upsert(tcols, source, keys, order_by)
    keyed, null_keys = split_source(align_types(source, schema), keys, order_by)
    if not measure:
        return MergeSource(keyed, null_keys)
    from tidewater.session import materialize_measured
    limit = broadcast_limit if broadcast_limit is not None else int(spark.conf.get(BROADCAST_LIMIT_CONF, str(DEFAULT_BROADCAST_LIMIT)))
    written, on_disk, in_memory = materialize_measured(keyed, "upsert-source")
    return MergeSource(written, null_keys, on_disk <= limit and in_memory <= limit, [keyed])


def upsert(target: DataFrame, source: DataFrame, keys: list[str] | tuple[str, ...],
           order_by: str | None = None, defaults: dict[str, Any] | None = None,
           plan: str = "shuffle", broadcast_limit: int | None = None) -> DataFrame:
    """The merged target (same schema as ``target``); see :func:`plan_upsert`."""
    return plan_upsert(target, source, keys, order_by, defaults, plan, broadcast_limit)[0]


def plan_upsert(target: DataFrame, source: DataFrame, keys: list[str] | tuple[str, ...],
                order_by: str | None = None, defaults: dict[str, Any] | None = None,
                plan: str = "shuffle", broadcast_limit: int | None = None, source_ready: MergeSource | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """The merged target, and the frames already executed while planning it
    (the materialised source), for callers that read observed metrics.

    ``plan="shuffle"``: full outer join (any size).  ``plan="auto"``: a source that :func:`prepare_source` measures
    as small is broadcast and the target is never shuffled, otherwise the full outer join.
    """
    keys = list(keys)
    ready = source_ready or prepare_source(target.schema, source, keys, order_by, plan == "auto", broadcast_limit)
    merge = merge_broadcast if ready.small else merge_shuffled
    return merge(target, ready.keyed, ready.null_keys, keys, order_by, defaults), ready.executed
