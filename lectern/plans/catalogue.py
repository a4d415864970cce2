"""All queries of the library."""

from . import book_queries, import_queries, log_queries, report_queries, text_queries, tool_queries, vector_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES  # noqa: F401
