"""All named queries of the core library and their SQL."""

from __future__ import annotations

from lamina.plans import catalog, problems, services, star

_MODULES = (problems, catalog, star, services)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
