"""strftime-style format strings -> Spark datetime patterns (driver side only).

Specs carry C/Python ``strftime`` formats (``%Y-%m-%d``); Spark parses with
Java-style patterns.  Numeric fields use the variable-width letters (``M``,
``d``, ``H`` ...) so single-digit input parses, except when two directives
touch (``%Y%m%d``): then fixed two-digit letters are needed to split them.
"""

from __future__ import annotations

from functools import lru_cache

from tidewater.errors import JobError

# --- fixed values: directive -> (variable-width letter, fixed-width letter) --
_DIRECTIVES = {
    "Y": ("yyyy", "yyyy"),
    "y": ("yy", "yy"),
    "m": ("M", "MM"),
    "d": ("d", "dd"),
    "H": ("H", "HH"),
    "I": ("h", "hh"),
    "M": ("m", "mm"),
    "S": ("s", "ss"),
    "f": ("SSSSSS", "SSSSSS"),
    "j": ("D", "DDD"),
    "b": ("MMM", "MMM"),
    "h": ("MMM", "MMM"),
    "B": ("MMMM", "MMMM"),
    "p": ("a", "a"),
    "z": ("xx", "xx"),
}
# --- fixed values: shorthand directives ---------------------------------------
_SHORTHANDS = {"F": "%Y-%m-%d", "T": "%H:%M:%S", "D": "%m/%d/%y", "R": "%H:%M"}
# Directives Spark cannot parse (weekday names, week numbers, locale forms).
_UNSUPPORTED = set("aAwuUWVGgcxXCsZ")


def _tokens(fmt: str) -> list[tuple[str, str]]:
    """Split into ('dir', letter) and ('lit', text) tokens, expanding shorthands."""
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%" and i + 1 < len(fmt):
            d = fmt[i + 1]
            i += 2
            if d == "%":
                out.append(("lit", "%"))
            elif d in _SHORTHANDS:
                out.extend(_tokens(_SHORTHANDS[d]))
            elif d in _DIRECTIVES:
                out.append(("dir", d))
            elif d in _UNSUPPORTED:
                raise JobError("SPEC_INVALID", f"date directive %{d} is not supported", fmt)
            else:
                raise JobError("SPEC_INVALID", f"unknown date directive %{d}", fmt)
        else:
            out.append(("lit", ch))
            i += 1
    return out


def _quote(text: str) -> str:
    if not text:
        return ""
    return "'" + text.replace("'", "''") + "'"


@lru_cache(maxsize=256)
def strftime_to_spark(fmt: str) -> str:
    """Translate one strftime format into a Spark datetime pattern."""
    toks = _tokens(fmt)
    parts: list[str] = []
    lit = ""
    for idx, (kind, val) in enumerate(toks):
        if kind == "lit":
            lit += val
            continue
        parts.append(_quote(lit))
        lit = ""
        prev_dir = idx > 0 and toks[idx - 1][0] == "dir"
        next_dir = idx + 1 < len(toks) and toks[idx + 1][0] == "dir"
        var, fixed = _DIRECTIVES[val]
        parts.append(fixed if (prev_dir or next_dir) else var)
    parts.append(_quote(lit))
    return "".join(parts)
