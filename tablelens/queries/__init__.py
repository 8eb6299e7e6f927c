"""Registered queries over the test tables, each with its check in SQL."""

from .registry import QUERIES, SQL

from . import tables, profile, cleaning, explore, findings, compare, preview, storage, catalogue, learning, reporting  # noqa: E402,F401  (registration)

__all__ = ["QUERIES", "SQL"]
