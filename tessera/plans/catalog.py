"""All core queries and their DuckDB twins."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("curation", "joins", "selection", "metrics", "losses", "contracts", "reports")
_FOUND = {k: v for m in _MODULES for k, v in import_module(f"{__package__}.{m}").QUERIES.items()}

QUERIES = {k: v[0] for k, v in _FOUND.items()}
ORACLE_SQL = {k: v[1] for k, v in _FOUND.items() if v[1]}
