"""Plans of the engine: whole queries over the tables of a folder."""

from corvane.plans.catalog import QUERIES, SQL, query, table
from corvane.plans import parsing, relations, rows, searching, stored, streams, texts  # noqa: F401, E402, I001  they register their queries

__all__ = ["QUERIES", "SQL", "query", "table"]
