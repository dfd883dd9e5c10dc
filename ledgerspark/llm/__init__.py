"""Operators for preparing training text: extraction, archives, deduplication, tokens, scores, search, mixing."""
