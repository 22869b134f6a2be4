"""Every registered query of the core operators, with the SQL that gives the same rows."""

from scenespark.plans import extras, joins, pixels, quality, seasons, series, stats, streams

_ALL = (seasons, series, joins, pixels, stats, quality, streams, extras)
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _ALL for k, q in m.ORACLE_SQL.items()}
