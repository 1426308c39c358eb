"""Observed metrics that never wait on a pruned plan.

``DataFrame.observe`` collects metrics while an action runs.  If Catalyst
proves the observed input empty (an always-false filter above it, e.g. NOT_NULL
on a column that cannot be NULL, or a REJECT rule that is always true), it
replaces the subtree with an empty relation and the metrics node disappears,
statically or at run time (AQE's empty-relation propagation).  A
:class:`Probe` reads its metrics only if an executed plan still contains its
node, and treats an action that finished without them as "input was empty".
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation


class Probe:
    def __init__(self, prefix: str):
        self.name = f"{prefix}-{uuid.uuid4().hex[:12]}"
        self.observation = Observation(self.name)

    def attach(self, df: DataFrame, *exprs) -> DataFrame:
        return df.observe(self.observation, *exprs)

    def present_in(self, df: DataFrame) -> bool:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return f"CollectMetrics {self.name}," in plan

    def result(self, *executed: DataFrame) -> dict:
        """Metrics once an action over one of ``executed`` has run; ``{}`` when
        every one of those plans lost the node (its input is provably empty)."""
        if not any(self.present_in(f) for f in executed):
            return {}
        try:
            return dict(self.observation.get)
        except Exception:  # noqa: BLE001 - the action ran but AQE pruned the node
            return {}
