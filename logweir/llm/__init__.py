"""Operators for preparing training text: cleaning, deduplication, scoring and archives.

Nothing outside this subpackage imports it.
"""
