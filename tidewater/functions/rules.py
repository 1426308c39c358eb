"""Row-local validation predicates (True = the row fails) and rule messages.

NOT_NULL, REGEX, RANGE and DATE_FORMAT only look at one row, so they are
plain boolean expressions.  UNIQUE and DUPLICATE_CHECK need the whole column
or row population and live in :mod:`tidewater.operators.duplicates`.
A predicate never yields NULL: a NULL outcome is a pass.
"""

from __future__ import annotations

import decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.errors import JobError
from tidewater.fixed import (
    COLUMN_LABEL,
    DEFAULT_DATE_FORMAT,
    ROW_LABEL,
    RULE_MESSAGES,
    UNKNOWN_RULE_MESSAGE,
)
from tidewater.functions.formats import strftime_to_spark
from tidewater.functions.transforms import _WIDE, _python_literal_fits, int_range, translate_pattern, typed_literal

ROW_LOCAL_RULES = ("NOT_NULL", "REGEX", "RANGE", "DATE_FORMAT")
POPULATION_RULES = ("UNIQUE", "DUPLICATE_CHECK")


def rule_message(rule_type: str, col: str | None, params: dict[str, Any]) -> str:
    label = COLUMN_LABEL.format(col=col) if col else ROW_LABEL
    tpl = RULE_MESSAGES.get(rule_type.upper())
    if tpl is None:
        return UNKNOWN_RULE_MESSAGE.format(rule=rule_type.upper())
    return tpl.format(label=label, pattern=params.get("pattern", ""),
                      min=_py_repr(params.get("min")), max=_py_repr(params.get("max")),
                      format=params.get("format", ""))


def _py_repr(v: Any) -> str:
    # rendered the way Python's f-string renders the value (None -> "None")
    return str(v)


def _outside(c: Column, value: Any, t: T.DataType, low: bool) -> Column:
    """``c`` below (``low``) or above the bound, NULL for a NULL value.

    The bound is brought to the column's type on the driver without changing
    any outcome: a fraction between two of the type's values is moved to the one
    inside, a bound beyond the type's range makes all values fail or none.
    """
    if isinstance(t, T.StringType):
        return c < F.lit(str(value)) if low else c > F.lit(str(value))
    whole = isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if isinstance(value, bool) or not (whole or isinstance(t, T.DecimalType)):
        if not _python_literal_fits(value, t):
            raise JobError("SPEC_INVALID", f"RANGE bound {value!r} does not fit column type {t.simpleString()}")
        return c < typed_literal(value, t) if low else c > typed_literal(value, t)
    try:
        d = decimal.Decimal(str(value).strip())
    except decimal.InvalidOperation:
        raise JobError("SPEC_INVALID", f"RANGE bound {value!r} does not fit column type {t.simpleString()}") from None
    if d.is_nan():
        return F.lit(False)
    if whole:
        least, most = (decimal.Decimal(x) for x in int_range(t))
        unit = decimal.Decimal(1)
    else:
        unit = decimal.Decimal(1).scaleb(-t.scale)
        most = decimal.Decimal(10) ** (t.precision - t.scale) - unit
        least = -most
    if d > most or d < least:
        return F.lit((d > most) == low)
    inside = d.quantize(unit, rounding=decimal.ROUND_CEILING if low else decimal.ROUND_FLOOR, context=_WIDE)
    bound = F.lit(str(inside)).cast(t)
    return c < bound if low else c > bound


def row_predicate(rule_type: str, c: Column, t: T.DataType, params: dict[str, Any]) -> Column | None:
    """Failure predicate for a row-local rule, or None when the rule is skipped."""
    rt = rule_type.upper()
    if rt == "NOT_NULL":
        return c.isNull()
    if rt == "REGEX":
        pattern = params.get("pattern", "")
        if not pattern:
            return None
        s = c if isinstance(t, T.StringType) else c.cast("string")
        # unanchored search; a NULL value passes
        return F.coalesce(~s.rlike(translate_pattern(str(pattern))), F.lit(False))
    if rt == "RANGE":
        lo, hi = params.get("min"), params.get("max")
        fail = [_outside(c, v, t, low) for v, low in ((lo, True), (hi, False)) if v is not None]
        if not fail:
            return F.lit(False)
        # NULL passes; in this form the complement, c IS NULL OR (c >= lo AND c <= hi), reaches the scan
        return c.isNotNull() & (fail[0] | fail[1] if len(fail) == 2 else fail[0])
    if rt == "DATE_FORMAT":
        fmt = strftime_to_spark(str(params.get("format") or DEFAULT_DATE_FORMAT))
        s = c if isinstance(t, T.StringType) else c.cast("string")
        return c.isNotNull() & F.try_to_date(s, fmt).isNull()
    return None
