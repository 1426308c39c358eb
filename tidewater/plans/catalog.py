"""Registry of driver queries: name -> (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

from tidewater.plans import catalog_core, catalog_flow, catalog_lossless, catalog_recovery

REGISTRY: dict = {}
REGISTRY.update(catalog_core.QUERIES)
REGISTRY.update(catalog_flow.QUERIES)
REGISTRY.update(catalog_lossless.QUERIES)
REGISTRY.update(catalog_recovery.QUERIES)
