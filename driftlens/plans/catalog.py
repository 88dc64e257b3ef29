"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from driftlens.plans import evaluation, events, features, learning, maintenance, scoring

_PARTS = (events, features, scoring, evaluation, learning, maintenance)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
FLAGSHIP = "evaluate_rule"
