"""Registered queries on the star-schema test tables, each with its SQL counterpart."""

from . import cohorts, cytometry, group_stats, identifiers, primers, sequences  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
