"""Registered queries of the training-data operators: thin digests of the operators' results."""

from __future__ import annotations

from sieveline.llm import query_filters, query_groups, query_models, query_texts  # noqa: F401
from sieveline.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
