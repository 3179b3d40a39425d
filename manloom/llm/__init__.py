"""Training-data operators.  Nothing outside this subpackage imports it."""

from __future__ import annotations

from . import queries as _queries

queries = _queries.queries
oracle_sql = _queries.oracle_sql
