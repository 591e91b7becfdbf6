"""All registered queries and their SQL equivalents."""

from . import corpus_queries, edit_queries, outline_queries, scalar_queries, search_queries

_GROUPS = (scalar_queries, corpus_queries, outline_queries, edit_queries, search_queries)
QUERIES = {name: fn for group in _GROUPS for name, fn in group.QUERIES.items()}
ORACLES = {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
