"""Queries over the shared tables, one per operator, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from statewatch.catalog.registry import ORACLES, QUERIES
from statewatch.catalog import (  # noqa: F401  (registration)
    alert_queries,
    contrast_queries,
    detector_queries,
    feature_queries,
    inference_queries,
    likelihood_queries,
    shaping_queries,
    state_queries,
    streaming_queries,
)

__all__ = ["ORACLES", "QUERIES"]
