"""Imports every module that registers queries."""

from . import fixture_queries, page_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
