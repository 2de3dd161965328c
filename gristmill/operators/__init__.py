"""Executing query documents: plain, batched, sampled, and comparisons of results."""
