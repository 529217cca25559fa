"""All queries of the library."""

from . import package_queries, paragraph_queries, record_queries, revision_queries, setting_queries, stream_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
