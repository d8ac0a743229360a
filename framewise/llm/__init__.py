"""Operators for preparing training text: deduplication, tokens, packing, scoring, archives, search."""
