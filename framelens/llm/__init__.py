"""Operators for preparing training text: deduplication, quality, archives, tokens."""
