"""Every registered query and its SQL."""

from . import measure_queries, text_queries, treat_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
