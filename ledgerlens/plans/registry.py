"""All registered queries of the engine, with their DuckDB counterparts."""

from __future__ import annotations

from . import catalog_queries, content_queries, endpoint_queries, layout_queries, line_queries, office_queries, source_queries, validation_queries

FLAGSHIP = "catalog_entries"
QUERIES: dict = {}
ORACLES: dict = {}
for _module in (catalog_queries, line_queries, content_queries, source_queries, endpoint_queries, layout_queries, office_queries, validation_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
