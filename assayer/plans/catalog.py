"""All registered queries."""

from assayer.plans import q_code, q_findings, q_rules, q_sources, q_stream, q_trace  # noqa: F401
from assayer.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
