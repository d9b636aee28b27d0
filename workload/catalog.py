"""All registered queries: importing the modules registers them."""

from . import q_families, q_flow, q_hierarchy, q_hits, q_intervals, q_jobs, q_sequences, q_sources  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
