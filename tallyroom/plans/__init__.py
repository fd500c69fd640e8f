"""Registered queries and their SQL."""

from . import budget, projects  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
