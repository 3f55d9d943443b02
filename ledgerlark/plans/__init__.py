"""Registered queries (Spark plan + DuckDB oracle) per operator."""

from . import catalog, cleaning_queries, profile_queries, source_queries, weekly_queries  # noqa: F401
from .catalog import REGISTRY  # noqa: F401
