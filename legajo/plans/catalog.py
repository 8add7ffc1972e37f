"""All queries of the general operators."""

from legajo.plans import assessment, evidence, relational, textual  # noqa: F401  (they register themselves)
from legajo.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
