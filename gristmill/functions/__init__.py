"""Predicates and aggregates of the query contract as Spark columns."""
