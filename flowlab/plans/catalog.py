"""All registered queries and their complete SQL twins."""

from flowlab.plans import adapters, audits, cleaning, drift, learning, sampling, scans, scoring, transfer  # noqa: F401
from flowlab.plans.registry import QUERIES, TWINS, with_tables

ORACLES = {name: with_tables(sql) for name, sql in TWINS.items()}

__all__ = ["ORACLES", "QUERIES"]
