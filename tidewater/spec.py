"""Job description as frozen dataclasses — the logical plan of one load.

A spec can be built in code or from a plain dict (the JSON shape a metadata
store would hold).  All checks that do not need data run here, on the driver,
before any Spark job starts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from tidewater.errors import JobError
from tidewater.fixed import ACTIONS, LOAD_STRATEGIES, VALIDATION_RULES


@dataclass(frozen=True)
class TransformRule:
    transform_type: str
    params: dict[str, Any] = field(default_factory=dict)
    apply_order: int = 0


@dataclass(frozen=True)
class ColumnMapping:
    target_column: str
    source_column: str | None = None
    ordinal_position: int = 0
    is_constant: bool = False
    constant_value: str | None = None
    default_value: str | None = None
    is_nullable: bool = True
    is_excluded: bool = False
    source_type: str | None = None
    target_type: str | None = None
    transform_rules: tuple[TransformRule, ...] = ()


@dataclass(frozen=True)
class ValidationRule:
    rule_type: str
    column: str | None = None  # the mapping's *target* column; None for row rules
    params: dict[str, Any] = field(default_factory=dict)
    action_on_fail: str = "REJECT"


@dataclass(frozen=True)
class SourceSpec:
    """Where rows come from.

    kind: ``parquet`` | ``csv`` | ``jdbc`` | ``table`` | ``sql`` | ``orc`` | ``json``.
    ``query`` replaces the table for ``jdbc`` / ``sql``.  ``checkpoint_col`` is
    the high-water-mark column of incremental loads.
    """

    kind: str
    path: str | None = None
    table: str | None = None
    query: str | None = None
    checkpoint_col: str | None = None
    options: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class TargetSpec:
    """Where rows go.  kind: ``parquet`` | ``csv`` | ``jdbc`` | ``table`` | ``orc``."""

    kind: str
    path: str | None = None
    table: str | None = None
    create_if_not_exists: bool = True
    partition_by: tuple[str, ...] = ()
    defaults: dict[str, Any] = field(default_factory=dict)  # column -> default for absent columns
    evolve: str = "none"  # "add": a column that the target lacks is added to it, NULL in older rows
    options: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class JobSpec:
    name: str
    source: SourceSpec
    target: TargetSpec
    job_id: str | None = None
    mappings: tuple[ColumnMapping, ...] = ()
    rules: tuple[ValidationRule, ...] = ()
    load_strategy: str = "FULL_LOAD"
    upsert_keys: tuple[str, ...] = ()
    order_by: str | None = None  # "last duplicate wins" order for UPSERT
    batch_size: int = 10000
    schema_drift_action: str = "WARN"
    expected_schema: Any = None  # StructType or DDL string checked by the drift step
    row_key: tuple[str, ...] = ()  # columns that identify a row in violation records
    keep_unmapped: bool = True
    row_index: bool = False  # add a dense 0-based row number to violation records
    mark_from: str = "valid"  # "valid" (as the original) or "source"
    cache: bool = False  # cache the flagged frame for the violation pass and the write

    @property
    def id(self) -> str:
        return self.job_id or self.name


def _rule_from_dict(d: dict) -> TransformRule:
    return TransformRule(
        transform_type=str(d["transform_type"]),
        params=dict(d.get("params") or {}),
        apply_order=int(d.get("apply_order", 0)),
    )


def mapping_from_dict(d: dict, position: int = 0) -> ColumnMapping:
    rules = tuple(_rule_from_dict(r) for r in d.get("transform_rules") or ())
    return ColumnMapping(
        target_column=d["target_column"],
        source_column=d.get("source_column"),
        ordinal_position=int(d.get("ordinal_position", position)),
        is_constant=bool(d.get("is_constant", False)),
        constant_value=d.get("constant_value"),
        default_value=d.get("default_value"),
        is_nullable=bool(d.get("is_nullable", True)),
        is_excluded=bool(d.get("is_excluded", False)),
        source_type=d.get("source_type"),
        target_type=d.get("target_type"),
        transform_rules=rules,
    )


def validation_from_dict(d: dict) -> ValidationRule:
    col = d.get("column")
    if col is None and isinstance(d.get("mapping"), dict):
        col = d["mapping"].get("target_column")
    return ValidationRule(
        rule_type=str(d["rule_type"]),
        column=col,
        params=dict(d.get("params") or {}),
        action_on_fail=str(d.get("action_on_fail") or "REJECT"),
    )


def job_from_dict(d: dict) -> JobSpec:
    """Build a :class:`JobSpec` from the metadata-store JSON shape."""
    src_cfg = dict(d.get("source_config") or {})
    tgt_cfg = dict(d.get("target_config") or {})
    if d.get("source_connection") or d.get("target_connection"):
        return _job_from_connections(d, src_cfg, tgt_cfg)
    src_opts = dict(src_cfg.get("options") or {})
    for k in ("lookback", "mark_partition_column", "delimiter", "encoding", "header", "schema", "multiLine", "bad_rows"):
        if k in src_cfg:
            src_opts.setdefault(k, src_cfg[k])
    source = SourceSpec(
        kind=str(d.get("source_type") or src_cfg.pop("kind", "table")).lower(),
        path=src_cfg.get("path"),
        table=src_cfg.get("table"),
        query=src_cfg.get("query"),
        checkpoint_col=src_cfg.get("checkpoint_col"),
        options=src_opts,
    )
    target = TargetSpec(
        kind=str(d.get("target_type") or tgt_cfg.pop("kind", "table")).lower(),
        path=tgt_cfg.get("path"),
        table=tgt_cfg.get("table"),
        create_if_not_exists=bool(tgt_cfg.get("create_if_not_exists", True)),
        partition_by=tuple(tgt_cfg.get("partition_by") or ()),
        defaults=dict(tgt_cfg.get("defaults") or {}),
        evolve=str(tgt_cfg.get("evolve") or "none").lower(),
        options=dict(tgt_cfg.get("options") or {}),
    )
    return _finish_job(d, source, target)


def _job_from_connections(d: dict, src_cfg: dict, tgt_cfg: dict) -> JobSpec:
    """Pipelines stored with connection objects (type, host, port, ...)."""
    from tidewater.sources.connections import source_from_connection, target_from_connection
    source = source_from_connection(d["source_connection"], src_cfg)
    target = target_from_connection(d["target_connection"], tgt_cfg)
    return _finish_job(d, source, target)


def _finish_job(d: dict, source: SourceSpec, target: TargetSpec) -> JobSpec:
    spec = JobSpec(
        name=d["name"],
        job_id=d.get("id"),
        source=source,
        target=target,
        mappings=tuple(mapping_from_dict(m, i) for i, m in enumerate(d.get("column_mappings") or ())),
        rules=tuple(validation_from_dict(r) for r in d.get("validation_rules") or ()),
        load_strategy=str(d.get("load_strategy") or "FULL_LOAD"),
        upsert_keys=tuple(d.get("upsert_keys") or ()),
        order_by=d.get("order_by"),
        batch_size=int(d.get("batch_size") or 10000),
        schema_drift_action=str(d.get("schema_drift_action") or "WARN"),
        expected_schema=d.get("expected_schema"),
        row_key=tuple(d.get("row_key") or ()),
        keep_unmapped=bool(d.get("keep_unmapped", True)),
        row_index=bool(d.get("row_index", False)),
        mark_from=str(d.get("mark_from") or "valid"),
        cache=bool(d.get("cache", False)),
    )
    check_spec(spec)
    return spec


def check_spec(spec: JobSpec) -> None:
    """Driver-side checks; raise ``JobError('SPEC_INVALID', ...)``."""
    strategy = spec.load_strategy.upper()
    if strategy not in LOAD_STRATEGIES:
        raise JobError("SPEC_INVALID", f"unknown load strategy {spec.load_strategy!r}",
                            f"known: {list(LOAD_STRATEGIES)}")
    if strategy == "UPSERT" and not spec.upsert_keys:
        raise JobError("SPEC_INVALID", "UPSERT needs upsert_keys")
    if strategy == "INCREMENTAL" and not spec.source.checkpoint_col:
        raise JobError("SPEC_INVALID", "INCREMENTAL needs source checkpoint_col")
    for r in spec.rules:
        if r.action_on_fail.upper() not in ACTIONS:
            raise JobError("SPEC_INVALID", f"unknown action {r.action_on_fail!r}",
                                f"known: {list(ACTIONS)}")
        rt = r.rule_type.upper()
        if rt in VALIDATION_RULES and rt != "DUPLICATE_CHECK" and not r.column:
            raise JobError("SPEC_INVALID", f"rule {rt} needs a column")
    if spec.schema_drift_action.upper() not in ("WARN", "STOP", "IGNORE"):
        raise JobError("SPEC_INVALID", f"unknown drift action {spec.schema_drift_action!r}")
    if spec.target.evolve not in ("none", "add"):
        raise JobError("SPEC_INVALID", f"evolve must be 'none' or 'add', not {spec.target.evolve!r}")
    if spec.mark_from not in ("valid", "source"):
        raise JobError("SPEC_INVALID", f"mark_from must be 'valid' or 'source'")
