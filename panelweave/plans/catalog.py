"""All registered queries."""

from __future__ import annotations

from panelweave.plans import (  # noqa: F401
    attribution_queries,
    evaluation_queries,
    feature_queries,
    forecast_queries,
    table_queries,
)
from panelweave.plans.registry import QUERIES

__all__ = ["QUERIES"]
