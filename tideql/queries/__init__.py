"""Rules over the test tables, one for each operator, with SQL of the same results."""

from __future__ import annotations

from . import calls, frames, rules

QUERIES = rules.QUERIES | calls.QUERIES | frames.QUERIES
ORACLE_SQL = rules.ORACLE_SQL | calls.ORACLE_SQL | frames.ORACLE_SQL
