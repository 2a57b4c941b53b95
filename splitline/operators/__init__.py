"""DataFrame transforms: boards, joins, aggregates, windows, data quality, scoring, solvers."""
