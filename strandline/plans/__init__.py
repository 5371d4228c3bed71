"""Registered queries and their equivalents in DuckDB's SQL."""
