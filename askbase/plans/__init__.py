"""Fixture adapters, the query registry and the DuckDB oracle."""
