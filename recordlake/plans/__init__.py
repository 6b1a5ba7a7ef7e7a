"""Query catalogue of the record archive engine."""

from . import audit_queries, browse_queries, chat_queries, cleaning_queries, history_queries, publish_queries, search_queries, stream_queries, tag_queries, temporal_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
