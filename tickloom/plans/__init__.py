"""Composed queries over the driver's tables, and the SQL that they agree with."""

from . import corpora, market, samples
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "corpora", "market", "samples"]
