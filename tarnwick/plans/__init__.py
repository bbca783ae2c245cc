"""Tarnwick plans."""
