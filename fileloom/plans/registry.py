"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from . import duplicates, media, naming, stores, streams, trees, walks

_MODULES = [duplicates, naming, trees, media, stores, streams, walks]
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL = {k: q for m in _MODULES for k, q in m.SQL.items()}
