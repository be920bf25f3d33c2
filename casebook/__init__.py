"""Registered queries over the driver's tables, each with its SQL twin where SQL can say it."""

from . import geo, relational, stats  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
