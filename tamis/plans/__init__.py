"""Queries over the test tables, each with its DuckDB SQL."""

from . import advanced, catalog, decision, flows, governance, messages, names, quality, registry, review, screen, sources, state

_PARTS = (names, screen, catalog, decision, messages, sources, advanced, state, quality, flows, governance, review, registry)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE = {k: v for part in _PARTS for k, v in part.ORACLE.items()}
