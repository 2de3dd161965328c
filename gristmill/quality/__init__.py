"""Checks and repair of the event table, and of views against it."""
