"""Persistent arrays, byte files and text forms."""
