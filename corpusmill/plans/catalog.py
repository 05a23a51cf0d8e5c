"""All queries of the engine by name, and the SQL that expresses them."""

from __future__ import annotations

from . import file_queries, management_queries, more_queries, retrieval_queries, store_queries, text_queries

FLAGSHIP = "hybrid_search"
QUERIES = {**retrieval_queries.QUERIES, **text_queries.QUERIES, **management_queries.QUERIES, **more_queries.QUERIES, **store_queries.QUERIES, **file_queries.QUERIES}
ORACLES = {**retrieval_queries.ORACLES, **text_queries.ORACLES, **management_queries.ORACLES, **more_queries.ORACLES, **store_queries.ORACLES, **file_queries.ORACLES}
