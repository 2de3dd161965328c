"""Keeping additive views fresh from a stream of events."""
