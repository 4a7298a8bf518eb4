"""Queries over the driver's tables: adapters, registry and DuckDB counterparts."""
