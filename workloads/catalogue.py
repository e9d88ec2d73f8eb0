"""All registered queries."""

from workloads import results, sequence, tracks  # noqa: F401
from workloads.base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
