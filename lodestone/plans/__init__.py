"""The queries of the library by name."""

from lodestone.plans import analytics, files, parsing  # noqa: F401
from lodestone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
