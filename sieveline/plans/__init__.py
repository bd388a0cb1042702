"""Registered queries and their SQL twins."""

from sieveline.plans import decisions, detection, messages, policy, rules, streams  # noqa: F401
from sieveline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
