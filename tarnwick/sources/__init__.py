"""Tarnwick sources."""
