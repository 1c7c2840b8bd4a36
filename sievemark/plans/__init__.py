"""Registered queries over the standard tables, and their SQL."""

from sievemark.plans import evidence, numeric, text

_MODULES = (numeric, text, evidence)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
