"""Every query outside the llm subpackage, and its SQL."""

from __future__ import annotations

from . import catalog, graph, index, pages, positions, relations, store, suggest, text, words

QUERIES = text.QUERIES | index.QUERIES | graph.QUERIES | suggest.QUERIES | catalog.QUERIES | pages.QUERIES | store.QUERIES | words.QUERIES | positions.QUERIES | relations.QUERIES
SQL: dict[str, str] = text.SQL | index.SQL | graph.SQL | suggest.SQL | catalog.SQL | pages.SQL | store.SQL | words.SQL | positions.SQL | relations.SQL
FLAGSHIP = "outgoing_suggestions"
