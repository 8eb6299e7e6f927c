"""Registered queries of the operators, each with its check in SQL where SQL can express it."""

from .registry import QUERIES, SQL

from . import balltree, decontaminate, html, language, lexical, mixing, negatives, phrases, pii, quality, repeats, simhash, warc  # noqa: E402,F401  (registration)

__all__ = ["QUERIES", "SQL"]
