"""All registered queries: importing the modules fills the registry."""

from __future__ import annotations

from daybook.plans import (  # noqa: F401
    queries_diagnostics,
    queries_features,
    queries_learning,
    queries_scores,
    queries_sources,
)
from daybook.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
