"""Materialized views, routing of queries to them, and advice about both."""
