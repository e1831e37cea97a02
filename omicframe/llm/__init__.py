"""Operators for preparing language-model training data, their queries and the SQL they are checked against."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
