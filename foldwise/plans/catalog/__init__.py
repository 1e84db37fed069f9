"""Queries over the given tables, each with its SQL counterpart where SQL can express it."""

from foldwise.plans.catalog import grids, models, network, preparation, report, scaling, selection  # noqa: F401
from foldwise.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
