"""All registered queries over the relational tables, and their SQL."""

from __future__ import annotations

from guardframe.plans import audit_queries, function_queries, guard_queries, log_queries, policy_queries, token_queries

_MODULES = (token_queries, policy_queries, guard_queries, audit_queries, log_queries, function_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.Q.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
