"""Tarnwick functions."""
