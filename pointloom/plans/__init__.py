"""The catalogue: every query of the library by name, and the SQL that gives its rows where SQL can."""

from __future__ import annotations

from . import measures, pieces, relational, sequences, timeline

PARTS = (relational, timeline, measures, sequences, pieces)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
