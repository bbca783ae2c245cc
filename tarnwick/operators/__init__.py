"""Tarnwick operators."""
