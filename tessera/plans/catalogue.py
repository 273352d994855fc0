"""Every query by name, and the SQL to hold it against."""

from . import extension_queries, series_queries, source_queries, space_queries, vector_queries  # noqa: F401  (they register their queries)
from .registry import ORACLE_SQL, QUERIES, STATUS

__all__ = ["ORACLE_SQL", "QUERIES", "STATUS"]
