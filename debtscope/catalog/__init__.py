"""Queries bound to the given tables, each with the SQL that checks it."""

from debtscope.catalog import code, datasets, files, languages, provenance, scores, statistics, structure, texts  # noqa: F401
from debtscope.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
