"""The registered queries and their DuckDB texts."""
