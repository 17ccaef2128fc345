"""Every query of the library, by name, over the given tables."""

from __future__ import annotations

from vintagerisk.plans import queries_dirty, queries_ingest, queries_models, queries_panel, queries_risk, queries_validation  # noqa: F401  (registration)
from vintagerisk.plans.core import QUERIES

__all__ = ["QUERIES"]
