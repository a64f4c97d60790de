"""Operators for preparing training text: search, classification, tokens, packing, filtering and deduplication."""
