"""Column mapping (rename, in-place map, constant, exclude, missing source,
pass-through, rule chains, auto-map) folded into ONE ``select``.

Mappings run in ``ordinal_position`` order and each sees the previous one's
output.  Instead of rebuilding the frame per mapping, the fold keeps an
ordered environment ``name -> (Column, DataType)`` whose expressions refer to
the *input* columns only; the result is a single Project (plus one Filter for
NULL_HANDLING drop rules), so analysis stays linear in the number of mappings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.errors import JobError
from tidewater.fixed import ERROR_MESSAGES
from tidewater.functions.transforms import FoldContext, apply_chain
from tidewater.spec import ColumnMapping


@dataclass
class MappingResult:
    frame: DataFrame
    warnings: list[str]
    source_names: dict[str, str]  # output column -> input column it was derived from


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def apply_mappings(df: DataFrame, mappings, keep_unmapped: bool = True,
                   honour_excluded: bool = True) -> MappingResult:
    """Fold the mappings over ``df`` and return one projected frame.

    ``keep_unmapped=False`` keeps only the columns some mapping produced
    (column pruning then reaches the scan).  Excluded mappings drop their
    source column (``honour_excluded=False`` reproduces runs that filtered
    excluded mappings out before the fold).
    """
    env: dict[str, tuple[Column, T.DataType]] = {
        f.name: (F.col(_q(f.name)), f.dataType) for f in df.schema.fields
    }
    origin: dict[str, str] = {f.name: f.name for f in df.schema.fields}
    produced: list[str] = []
    ctx = FoldContext()

    for m in sorted(mappings, key=lambda m: m.ordinal_position):
        if m.is_excluded:
            if honour_excluded and m.source_column and m.source_column in env:
                del env[m.source_column]
                origin.pop(m.source_column, None)
            continue

        if m.is_constant:
            value = m.constant_value
            env[m.target_column] = (F.lit(None if value is None else str(value)).cast("string"), T.StringType())
            origin.pop(m.target_column, None)
            produced.append(m.target_column)
            continue

        src = m.source_column
        if src is None or src not in env:
            if not m.is_nullable and m.default_value is None:
                raise JobError("COLUMN_NOT_FOUND", ERROR_MESSAGES["COLUMN_NOT_FOUND"].format(col=src))
            value = m.default_value
            env[m.target_column] = (F.lit(None if value is None else str(value)).cast("string"), T.StringType())
            origin.pop(m.target_column, None)
            produced.append(m.target_column)
            continue

        c, t = env[src]
        c, t = apply_chain(c, t, m.transform_rules, ctx)
        src_origin = origin.get(src)
        if src != m.target_column:
            del env[src]
            origin.pop(src, None)
        env[m.target_column] = (c, t)
        if src_origin is not None:
            origin[m.target_column] = src_origin
        else:
            origin.pop(m.target_column, None)
        produced.append(m.target_column)

    names = list(env.keys())
    if not keep_unmapped:
        keep = set(produced)
        names = [n for n in names if n in keep]
    base = df
    if ctx.keep_predicates:
        pred = ctx.keep_predicates[0]
        for p in ctx.keep_predicates[1:]:
            pred = pred & p
        base = df.where(pred)
    try:
        out = base.select(*[env[n][0].alias(n) for n in names])
    except AnalysisException as e:  # e.g. a cast Spark cannot do at all (struct -> int)
        code = "CAST_ERROR" if "CAST" in str(e).upper() else "SCHEMA_FAILED"
        raise JobError(code, ERROR_MESSAGES["TRANSFORM_FAILED"], str(e)[:2000]) from e
    return MappingResult(out, ctx.warnings, {n: origin[n] for n in names if n in origin})


def auto_map(source_schema: T.StructType, target_schema: T.StructType | None = None) -> list[ColumnMapping]:
    """One mapping per source column, to the same-named target column or itself.

    Types are recorded for display only; nullability comes from the source.
    """
    tgt = {f.name: f for f in (target_schema.fields if target_schema else [])}
    out = []
    for i, f in enumerate(source_schema.fields):
        t = tgt.get(f.name)
        out.append(ColumnMapping(
            source_column=f.name,
            target_column=t.name if t else f.name,
            source_type=f.dataType.simpleString(),
            target_type=(t.dataType if t else f.dataType).simpleString(),
            is_nullable=f.nullable,
            ordinal_position=i,
        ))
    return out
