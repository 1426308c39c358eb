"""tidewater — declarative batch / micro-batch load jobs expressed as Spark plans.

A job is described as data (source, column mappings with ordered transform
rules, validation rules with REJECT / WARN / STOP actions, a load strategy);
the library turns that description into ordinary DataFrame plans.

    from tidewater import JobSpec, SourceSpec, TargetSpec, run_job
"""

from tidewater.errors import JobError, ValidationStop
from tidewater.operators.mapping import apply_mappings, auto_map
from tidewater.operators.merge import upsert
from tidewater.operators.validate import validate
from tidewater.plans.runner import RunResult, run_job
from tidewater.plans.store import RunStore
from tidewater.sources.readers import read_source
from tidewater.sources.sinks import write_frame
from tidewater.spec import (
    ColumnMapping,
    JobSpec,
    SourceSpec,
    TargetSpec,
    TransformRule,
    ValidationRule,
    job_from_dict,
)
from tidewater.streaming.scheduled import start_stream

__all__ = [
    "ColumnMapping", "JobError", "JobSpec", "RunResult", "RunStore", "SourceSpec", "TargetSpec",
    "TransformRule", "ValidationRule", "ValidationStop", "apply_mappings", "auto_map", "job_from_dict",
    "read_source", "run_job", "start_stream", "upsert", "validate", "write_frame",
]
