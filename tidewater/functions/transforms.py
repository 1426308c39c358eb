"""The 13 column transforms as typed Column expressions (no UDFs).

Each transform maps ``(Column, DataType, params) -> (Column, DataType)``.  The
type is tracked statically so a chain of rules is folded into one nested
expression that Catalyst compiles into a single whole-stage-codegen Project.
"""

from __future__ import annotations

import datetime as _dt
import decimal
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.errors import JobError
from tidewater.fixed import (
    CAST_ALIASES,
    DEFAULT_DATE_FORMAT,
    DEFAULT_TIMESTAMP_FORMAT,
    UNICODE_WHITESPACE,
)
from tidewater.functions.formats import strftime_to_spark

INT_MAX = 2147483647


@dataclass
class FoldContext:
    """Side outputs of a transform fold: warnings and row-drop predicates."""

    warnings: list[str] = field(default_factory=list)
    keep_predicates: list[Column] = field(default_factory=list)


def as_string(c: Column, t: T.DataType) -> Column:
    return c if isinstance(t, T.StringType) else c.cast("string")


def cast_target(to_type: str | None) -> str:
    """Resolve a CAST alias; unknown names fall back to string."""
    return CAST_ALIASES.get(str(to_type or "string").strip().lower(), "string")


def spark_type(name: str) -> T.DataType:
    return T.DataType.fromDDL(name)


# ---------------------------------------------------------------------------
# literals typed against a column
# ---------------------------------------------------------------------------

#: arithmetic on bounds and defaults, far wider than any column
_WIDE = decimal.Context(prec=400, Emax=999999, Emin=-999999)
_INT_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def int_range(t: T.DataType) -> tuple[int, int]:
    half = 1 << (_INT_BITS[type(t)] - 1)
    return -half, half - 1


def _python_literal_fits(value: Any, t: T.DataType) -> bool:
    """Driver-side check whether a literal converts to ``t`` without loss."""
    if value is None:
        return True
    s = str(value).strip()
    try:
        if isinstance(t, T.BooleanType):
            return s.lower() in ("true", "false", "t", "f", "yes", "no", "y", "n", "1", "0")
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            if isinstance(value, bool):
                return False
            lo, hi = int_range(t)
            return lo <= (value if isinstance(value, int) else int(s)) <= hi
        if isinstance(t, T.DecimalType):
            if isinstance(value, bool):
                return False
            d = decimal.Decimal(s)
            return d.is_finite() and d == d.quantize(decimal.Decimal(1).scaleb(-t.scale), context=_WIDE) \
                and abs(d) < decimal.Decimal(10) ** (t.precision - t.scale)
        if isinstance(t, (T.FloatType, T.DoubleType)):
            if isinstance(value, bool):
                return False
            float(s)
            return True
        if isinstance(t, T.DateType):
            _dt.date.fromisoformat(s)
            return True
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            _dt.datetime.fromisoformat(s)
            return True
        if isinstance(t, T.StringType):
            return True
    except (ValueError, TypeError, decimal.InvalidOperation):
        return False
    return False


def typed_literal(value: Any, t: T.DataType) -> Column:
    """A literal of the column's type (``value`` must fit, see above)."""
    if value is None:
        return F.lit(None).cast(t)
    if isinstance(t, T.StringType):
        return F.lit(str(value))
    return F.lit(str(value).strip()).try_cast(t)


def fill_nulls(c: Column, t: T.DataType, default: Any) -> tuple[Column, T.DataType]:
    """COALESCE / DEFAULT_VALUE / NULL_HANDLING(fill).

    The default keeps the column type when it converts to it without loss; an
    integer beyond the column's range widens the column to bigint; otherwise the
    column becomes text (the common supertype of a value and a string).
    """
    if default is None:
        return c, t
    if _python_literal_fits(default, t):
        return F.coalesce(c, typed_literal(default, t)), t
    if isinstance(t, tuple(_INT_BITS)) and _python_literal_fits(default, T.LongType()):
        return F.coalesce(c.cast("bigint"), typed_literal(default, T.LongType())), T.LongType()
    return F.coalesce(as_string(c, t), F.lit(str(default))), T.StringType()


# ---------------------------------------------------------------------------
# the transforms
# ---------------------------------------------------------------------------

def _trim(c, t, p, ctx):
    # F.trim with a character set strips any of the characters at both ends,
    # JVM-side and codegen'd (cheaper than a regex); the set is the Unicode
    # White_Space property, so \t, \n, NBSP and ideographic space go too.
    return F.trim(as_string(c, t), F.lit(UNICODE_WHITESPACE)), T.StringType()


def _upper(c, t, p, ctx):
    return F.upper(as_string(c, t)), T.StringType()


def _lower(c, t, p, ctx):
    return F.lower(as_string(c, t)), T.StringType()


def translate_pattern(pattern: str) -> str:
    """Regex in the source dialect -> Java regex with the same meaning.

    The source dialect's ``\\w``, ``\\d``, ``\\s`` and ``\\b`` are Unicode-aware
    (``\\w`` matches "ş", "ğ"); Java's are ASCII unless UNICODE_CHARACTER_CLASS
    ``(?U)`` is on.  Named groups ``(?P<name>...)`` are written ``(?<name>...)``.
    """
    out = pattern.replace("(?P<", "(?<")
    return out if out.startswith("(?U)") else "(?U)" + out


def _pattern_groups(pattern: str) -> tuple[int, set[str]] | None:
    """(number of groups, group names) of a pattern, or None when Python's
    parser does not accept it (then references are passed through)."""
    import re
    try:
        rx = re.compile(pattern.replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace("(?P<!", "(?<!"))
    except re.error:
        return None
    return rx.groups, set(rx.groupindex)


def translate_replacement(to: str, groups: tuple[int, set[str]] | None = None) -> str:
    """Replacement text in the ``$1`` / ``${name}`` / ``$name`` / ``$$`` syntax
    -> Java ``Matcher`` syntax.

    Backslashes are literal in the source syntax and are escaped for Java;
    ``$$`` is a literal dollar.  A reference to a group the pattern does not
    have expands to empty text (Java would fail the task instead); a digit
    that follows a numbered reference is escaped so Java does not read it as
    part of the group number.
    """
    n_groups, names = groups if groups is not None else (None, None)

    def ref(name: str) -> str:
        if name.isdigit():
            if n_groups is not None and int(name) > n_groups:
                return ""
            return f"${int(name)}"
        if names is not None and name not in names:
            return ""
        return "${" + name + "}"

    out: list[str] = []
    after_number = False
    i = 0
    while i < len(to):
        ch = to[i]
        if ch == "$" and to[i + 1:i + 2] == "$":
            out.append("\\$")
            i += 2
            after_number = False
            continue
        if ch == "$" and to[i + 1:i + 2] == "{" and "}" in to[i + 2:]:
            j = to.index("}", i + 2)
            name = to[i + 2:j]
            out.append(ref(name))
            after_number = name.isdigit() and out[-1] != ""
            i = j + 1
            continue
        if ch == "$" and (to[i + 1:i + 2].isalnum() or to[i + 1:i + 2] == "_"):
            j = i + 1
            while j < len(to) and (to[j].isalnum() or to[j] == "_"):
                j += 1
            name = to[i + 1:j]
            out.append(ref(name) if (name.isdigit() or not name[0].isdigit()) else "")
            after_number = name.isdigit() and out[-1] != ""
            i = j
            continue
        if ch == "$":
            out.append("\\$")
        elif ch == "\\":
            out.append("\\\\")
        elif ch.isdigit() and after_number:
            out.append("\\" + ch)
        else:
            out.append(ch)
        after_number = False
        i += 1
    return "".join(out)


def _replace(c, t, p, ctx):
    if "from" not in p or "to" not in p:
        raise JobError("SPEC_INVALID", "REPLACE needs 'from' and 'to'")
    s = as_string(c, t)
    if p.get("literal"):
        return F.replace(s, F.lit(str(p["from"])), F.lit(str(p["to"]))), T.StringType()
    pattern = str(p["from"])
    repl = translate_replacement(str(p["to"]), _pattern_groups(pattern))
    return F.regexp_replace(s, F.lit(translate_pattern(pattern)), F.lit(repl)), T.StringType()


def _cast(c, t, p, ctx):
    # unparsable or out-of-range values become NULL ('1.5' -> int is NULL,
    # -1.9 -> int truncates to -1, overflow is NULL); unknown names -> text
    tt = spark_type(cast_target(p.get("to_type", "string")))
    return c.try_cast(tt), tt


def _to_date(c, t, p, ctx):
    fmt = strftime_to_spark(str(p.get("format") or DEFAULT_DATE_FORMAT))
    return F.try_to_date(as_string(c, t), fmt), T.DateType()


def _to_timestamp(c, t, p, ctx):
    fmt = strftime_to_spark(str(p.get("format") or DEFAULT_TIMESTAMP_FORMAT))
    parsed = F.try_to_timestamp(as_string(c, t), F.lit(fmt))
    return parsed.cast("timestamp_ntz"), T.TimestampNTZType()


def substring_expr(s: Column, start: int, length: int | None) -> Column:
    """0-based start, negative counts from the end; no/zero length -> to the end.

    A negative start before the beginning is clamped to the first character
    (``('ab', -5, 3) -> 'ab'``, as slicing does); Spark's own ``substring``
    would shorten the length instead and return ``''``.
    """
    n = int(length) if length else INT_MAX
    if n < 0:
        raise JobError("SPEC_INVALID", "SUBSTRING length must be >= 0")
    if start >= 0:
        return F.substring(s, start + 1, n)
    return F.substring(s, F.greatest(F.lit(start), -F.length(s)), F.lit(n))


def _substring(c, t, p, ctx):
    start = int(p.get("start", 0) or 0)
    return substring_expr(as_string(c, t), start, p.get("length")), T.StringType()


def _concat(c, t, p, ctx):
    val = F.lit(str(p.get("value", "")))
    s = as_string(c, t)
    if p.get("position", "suffix") == "prefix":
        return F.concat(val, s), T.StringType()
    return F.concat(s, val), T.StringType()


def _coalesce(c, t, p, ctx):
    return fill_nulls(c, t, p.get("default", ""))


def _default_value(c, t, p, ctx):
    return fill_nulls(c, t, p.get("value", ""))


def _null_handling(c, t, p, ctx):
    strategy = str(p.get("strategy", "fill")).lower()
    if strategy == "fill":
        return fill_nulls(c, t, p.get("fill_value", ""))
    if strategy == "drop":
        # frame-level: rows whose value is null at this point of the chain go
        ctx.keep_predicates.append(c.isNotNull())
        return c, t
    raise JobError("SPEC_INVALID", f"unknown NULL_HANDLING strategy {strategy!r}")


def _literal_type(values: list[Any]) -> T.DataType:
    vals = [v for v in values if v is not None]
    if not vals:
        return T.StringType()
    if all(isinstance(v, bool) for v in vals):
        return T.BooleanType()
    if all(isinstance(v, int) and not isinstance(v, bool) for v in vals):
        return T.LongType()
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in vals):
        return T.DoubleType()
    return T.StringType()


def _case_when(c, t, p, ctx):
    conds = list(p.get("conditions") or [])
    otherwise = p.get("else")
    rt = _literal_type([x.get("then") for x in conds] + [otherwise])

    def out_lit(v):
        if v is None:
            return F.lit(None).cast(rt)
        return F.lit(str(v) if isinstance(rt, T.StringType) else v).cast(rt)

    expr = None
    for cond in conds:
        w = cond.get("when")
        if w is None:
            continue  # equality with null never holds
        if _python_literal_fits(w, t):
            test = c == typed_literal(w, t)
        else:
            test = as_string(c, t) == F.lit(str(w))
        expr = F.when(test, out_lit(cond.get("then"))) if expr is None else expr.when(test, out_lit(cond.get("then")))
    if expr is None:
        return out_lit(otherwise), rt
    return expr.otherwise(out_lit(otherwise)), rt


TRANSFORMS = {
    "TRIM": _trim,
    "UPPER": _upper,
    "LOWER": _lower,
    "REPLACE": _replace,
    "CAST": _cast,
    "TO_DATE": _to_date,
    "TO_TIMESTAMP": _to_timestamp,
    "SUBSTRING": _substring,
    "CONCAT": _concat,
    "COALESCE": _coalesce,
    "DEFAULT_VALUE": _default_value,
    "NULL_HANDLING": _null_handling,
    "CASE_WHEN": _case_when,
}


def apply_transform(c: Column, t: T.DataType, transform_type: str, params: dict | None,
                    ctx: FoldContext | None = None) -> tuple[Column, T.DataType]:
    """Apply one named transform; unknown names pass through with a warning."""
    ctx = ctx if ctx is not None else FoldContext()
    fn = TRANSFORMS.get(str(transform_type).upper())
    if fn is None:
        ctx.warnings.append(f"unknown transform {transform_type!r} passed through")
        return c, t
    try:
        return fn(c, t, dict(params or {}), ctx)
    except (ValueError, TypeError, KeyError, AttributeError) as e:  # malformed params in the spec
        raise JobError("SPEC_INVALID", f"{str(transform_type).upper()}: invalid params {params!r}", str(e)) from e


def apply_chain(c: Column, t: T.DataType, rules, ctx: FoldContext | None = None) -> tuple[Column, T.DataType]:
    """Apply rules sorted by ``apply_order``, each feeding the next."""
    ctx = ctx if ctx is not None else FoldContext()
    for r in sorted(rules, key=lambda r: r.apply_order):
        c, t = apply_transform(c, t, r.transform_type, r.params, ctx)
    return c, t
