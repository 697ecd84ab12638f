"""The queries of the reference operators, and their SQL."""

from __future__ import annotations

from .plans import borders, fires, geo, outlines, requests, retrieval, series, streams, tables, texts

_PLANS = (retrieval, texts, series, geo, fires, requests, borders, outlines, streams, tables)
QUERIES: dict = {k: f for m in _PLANS for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in _PLANS for k, s in m.SQL.items()}
FLAGSHIP = "hybrid_whole"
