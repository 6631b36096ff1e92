"""Registered queries, by module."""

from . import logs, measures, models, places, records, sources, streams

QUERIES = {n: f for m in (logs, places, records, measures, models, streams, sources) for n, f in m.add.queries.items()}
SQL = {n: s for m in (logs, places, records, measures, models, streams, sources) for n, s in m.add.sql.items()}
