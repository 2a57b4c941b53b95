"""The query catalogue on the test tables, with a DuckDB oracle wherever SQL can express the query."""
