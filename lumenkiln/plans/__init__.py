"""Named queries over the catalog; importing this registers all of them."""

from . import catalog_queries, ingest_queries, reader_queries, scalar_queries, source_queries, state_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
