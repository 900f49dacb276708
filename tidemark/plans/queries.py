"""Registered queries of the item engine and their SQL twins."""

from __future__ import annotations

from . import cleaning, evaluating, modelling, profiling_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
