"""Tarnwick streaming."""
