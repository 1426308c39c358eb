"""Validation: per-rule failure flags, row routing (REJECT / WARN / STOP),
violation (quarantine) records and counts.

All rules are evaluated on the post-mapping frame, independently; none sees
another's rejections.  The flags are columns of one "flagged" frame:

* row-local rules are expressions in a single Project (codegen'd);
* UNIQUE / DUPLICATE_CHECK add a flag through an aggregate + null-safe join
  (see :mod:`tidewater.operators.duplicates`).

From the flagged frame: ``valid`` = rows with no REJECT flag; ``violations``
= one record per (row, failing rule) built with ``explode`` over an array of
optional structs (no per-row Python); ``counts`` = one aggregate pass giving
every rule's failure count, the STOP decision and the WARN texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.errors import JobError, ValidationStop
from tidewater.fixed import STOP_TEMPLATE, WARN_TEMPLATE
from tidewater.functions.rules import POPULATION_RULES, ROW_LOCAL_RULES, row_predicate, rule_message
from tidewater.operators.duplicates import flag_duplicates
from tidewater.spec import ValidationRule


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class RuleEval:
    index: int
    rule_type: str
    column: str | None
    action: str
    message: str
    flag: str


@dataclass
class ValidationOutcome:
    flagged: DataFrame
    rules: list[RuleEval]
    data_columns: list[str]
    extra_columns: list[str] = field(default_factory=list)  # carried, not validated (e.g. row index)
    skipped: list[int] = field(default_factory=list)
    persisted: bool = False

    # ------------------------------------------------------------------ masks
    def _any(self, evals: list[RuleEval]) -> Column:
        if not evals:
            return F.lit(False)
        e = F.col(evals[0].flag)
        for r in evals[1:]:
            e = e | F.col(r.flag)
        return e

    @property
    def reject_mask(self) -> Column:
        return self._any([r for r in self.rules if r.action == "REJECT"])

    @property
    def any_failure(self) -> Column:
        return self._any(self.rules)

    # ---------------------------------------------------------------- outputs
    def valid(self, keep_extra: bool = False) -> DataFrame:
        cols = self.data_columns + (self.extra_columns if keep_extra else [])
        return self.flagged.where(~self.reject_mask).select(*[F.col(_q(c)) for c in cols])

    def rejected_rows(self) -> DataFrame:
        return self.flagged.where(self.reject_mask).select(*[F.col(_q(c)) for c in self.data_columns])

    def violations(self, row_key: tuple[str, ...] | list[str] = (), include_source: bool = True,
                   row_number_col: str | None = None, frame: DataFrame | None = None) -> DataFrame:
        """One record per (row, failing rule): key columns, optional row number,
        ``source_data`` (the whole row as a typed struct), error column / rule /
        message and the action."""
        recs = [
            F.when(F.col(r.flag), F.struct(
                F.lit(r.index).alias("rule_index"),
                F.lit(r.column or "").alias("error_column"),
                F.lit(r.rule_type).alias("error_rule"),
                F.lit(r.message).alias("error_message"),
                F.lit(r.action).alias("action"),
            ))
            for r in self.rules
        ]
        sel: list[Column] = [F.col(_q(k)) for k in row_key]
        if row_number_col:
            sel.append(F.col(_q(row_number_col)).alias("row_number"))
        if include_source:
            sel.append(F.struct(*[F.col(_q(c)) for c in self.data_columns]).alias("source_data"))
        base = frame if frame is not None else self.flagged
        if not recs:
            empty = base.where(F.lit(False)).select(*sel)
            return empty.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (
                ("rule_index", "int"), ("error_column", "string"), ("error_rule", "string"),
                ("error_message", "string"), ("action", "string"))])
        # explode the array of optional records, then drop the empty slots
        # (a plain Filter; no interpreted higher-order function)
        exploded = (base.where(self.any_failure)
                    .select(*sel, F.explode(F.array(*recs)).alias("__v"))
                    .where(F.col("__v").isNotNull()))
        keep = [c for c in exploded.columns if c != "__v"]
        return exploded.select(*[F.col(_q(c)) for c in keep], "__v.*")

    # ----------------------------------------------------------------- counts
    def count_exprs(self) -> list[Column]:
        exprs = [F.count(F.lit(1)).alias("__rows"),
                 F.count_if(self.reject_mask).alias("__rejected_rows")]
        exprs += [F.count_if(F.col(r.flag)).alias(r.flag) for r in self.rules]
        return exprs

    def counts(self) -> dict[str, int]:
        """One aggregate pass: rows, rejected rows, failures per rule flag."""
        row = self.flagged.agg(*self.count_exprs()).collect()[0]
        return {k: int(row[k] or 0) for k in row.asDict()}

    def check_stop(self, counts: dict[str, int]) -> None:
        """Raise for the first STOP rule (in rule order) with failures."""
        for r in self.rules:
            n = counts.get(r.flag, 0)
            if r.action == "STOP" and n > 0:
                raise ValidationStop(STOP_TEMPLATE.format(msg=r.message, n=n), r.index, n)

    def warnings(self, counts: dict[str, int]) -> list[str]:
        return [WARN_TEMPLATE.format(msg=r.message, n=counts.get(r.flag, 0))
                for r in self.rules if r.action == "WARN" and counts.get(r.flag, 0) > 0]

    def violation_record_count(self, counts: dict[str, int]) -> int:
        """Number of violation records: every failing (row, rule) pair, whatever the rule's action."""
        return sum(counts.get(r.flag, 0) for r in self.rules)

    def per_rule(self, counts: dict[str, int]) -> list[dict]:
        return [{"rule_index": r.index, "error_rule": r.rule_type, "error_column": r.column or "",
                 "action": r.action, "failures": counts.get(r.flag, 0)} for r in self.rules]

    def unpersist(self) -> None:
        if self.persisted:
            self.flagged.unpersist()
            self.persisted = False


def validate(df: DataFrame, rules: list[ValidationRule] | tuple[ValidationRule, ...],
             extra_columns: list[str] | tuple[str, ...] = (), persist: bool = False,
             materialize_keys: bool | str = "auto", seen: dict[str, DataFrame] | None = None) -> ValidationOutcome:
    """Flag every rule on ``df``.

    ``extra_columns`` are carried along but not validated (for example a row
    index).  The flagged frame is NOT cached by default: a run reads it twice
    (violation pass, target write), and re-scanning pruned, pushed-down
    Parquet is cheaper at scale than spilling every row to executor disks.
    What is expensive to recompute — the duplicate-key set of UNIQUE /
    DUPLICATE_CHECK — is written once to the shared checkpoint folder
    (``materialize_keys="auto"``: when such a rule exists) and joined from
    there.  ``persist=True`` caches the whole flagged frame instead.
    ``seen`` gives, by column, values (column ``key``) that count as occurring once more for UNIQUE.
    """
    extra = list(extra_columns)
    data_cols = [c for c in df.columns if c not in extra]
    types = {f.name: f.dataType for f in df.schema.fields}
    evals: list[RuleEval] = []
    skipped: list[int] = []
    local: list[tuple[str, Column]] = []
    population: list[tuple[str, list[str]]] = []

    for i, r in enumerate(rules):
        rt = r.rule_type.upper()
        action = (r.action_on_fail or "REJECT").upper()
        if action not in ("REJECT", "WARN", "STOP"):
            raise JobError("SPEC_INVALID", f"unknown action {r.action_on_fail!r}")
        flag = f"__fail{i}"
        col = r.column
        if rt in ROW_LOCAL_RULES:
            if not col or col not in types:
                skipped.append(i)
                continue
            pred = row_predicate(rt, F.col(_q(col)), types[col], r.params)
            if pred is None:
                skipped.append(i)
                continue
            local.append((flag, pred))
        elif rt == "UNIQUE":
            if not col or col not in types:
                skipped.append(i)
                continue
            population.append((flag, [col]))
        elif rt == "DUPLICATE_CHECK":
            population.append((flag, list(data_cols)))
        else:
            skipped.append(i)
            continue
        # the record names the rule's column even for DUPLICATE_CHECK (whose
        # check and message ignore it), as the original records it
        evals.append(RuleEval(i, rt, col, action, rule_message(rt, col, r.params), flag))

    flagged = df
    mat = bool(population) if materialize_keys == "auto" else bool(materialize_keys)
    for flag, cols in population:
        taken = (seen or {}).get(cols[0]) if len(cols) == 1 else None
        flagged = flag_duplicates(flagged, cols, flag, base=df, materialize_keys=mat, taken=taken)
    if local:
        flagged = flagged.select("*", *[p.alias(f) for f, p in local])
    # stable column order: data, extra, flags in rule order
    flagged = flagged.select(*[F.col(_q(c)) for c in data_cols + extra], *[F.col(e.flag) for e in evals])

    if persist:
        flagged = flagged.persist(StorageLevel.MEMORY_AND_DISK)
    return ValidationOutcome(flagged, evals, data_cols, extra, skipped, bool(persist))


__all__ = ["RuleEval", "ValidationOutcome", "validate", "POPULATION_RULES"]
