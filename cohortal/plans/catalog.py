"""All registered queries and their SQL."""

from __future__ import annotations

from cohortal.plans import checks, cohorts, evaluation, features, learning, pictures, records, reports  # noqa: F401
from cohortal.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
