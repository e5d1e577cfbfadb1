"""All registered queries and their SQL counterparts."""

from tablemill.catalog.registry import ORACLES, QUERIES
from tablemill.catalog import profiling, preparing, features, samples, clusters

__all__ = ["ORACLES", "QUERIES"]
