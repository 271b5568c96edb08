"""Operators on lines, streams and results."""
