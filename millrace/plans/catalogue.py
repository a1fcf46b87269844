"""All registered queries of the engine and their oracle SQL."""

from __future__ import annotations

from . import curation, search, sources, state

PARTS = (search, curation, state, sources)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
