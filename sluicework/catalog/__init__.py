"""Queries over the driver tables, one or more per operator, with their SQL counterparts."""

from . import joins, quality, recipes, routing, scalars, sinks, sources  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
