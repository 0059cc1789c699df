"""The registered queries and their SQL."""

from __future__ import annotations

from tidemark.plans import accounts, catalogue, depth, derivatives, market, performance, records, streams, technical

_MODULES = (market, technical, performance, depth, derivatives, accounts, records, catalogue, streams)
QUERIES = {name: f for m in _MODULES for name, f in m.Q.items()}
ORACLE_SQL = {name: text for m in _MODULES for name, text in m.S.items()}
