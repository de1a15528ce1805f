"""Streaming entry points: the periodic snapshot refresh."""
