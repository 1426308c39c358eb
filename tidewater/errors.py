"""Error types carrying a machine-readable code, a message and a detail."""

from __future__ import annotations


class JobError(Exception):
    """A failure of one run step, with a stable ``code``."""

    def __init__(self, code: str, message: str, detail: str | None = None):
        super().__init__(f"[{code}] {message}")
        self.code = code
        self.message = message
        self.detail = detail


class ValidationStop(JobError):
    """Raised when a STOP validation rule has at least one failing row."""

    def __init__(self, message: str, rule_index: int, failures: int):
        super().__init__("VALIDATION_STOP", message, str(failures))
        self.rule_index = rule_index
        self.failures = failures
