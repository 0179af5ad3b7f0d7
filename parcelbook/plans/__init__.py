"""Operators bound to the driver tables; importing this package fills the registry."""

from parcelbook.plans import cleansing, measures, relational, rules, sources, spatial, statistics  # noqa: F401
from parcelbook.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
