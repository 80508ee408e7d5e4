"""All queries of the core and their SQL."""

from __future__ import annotations

from weftline.plans import build_index, code_index, documents, history, log_sql, problems

_PARTS = (problems, code_index, build_index, history, documents)
QUERIES = {k: f for m in _PARTS for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in (*_PARTS, log_sql) for k, s in m.SQL.items()}
