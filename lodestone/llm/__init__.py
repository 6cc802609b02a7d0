"""Operators for preparing training text: identification, filtering, deduplication, scoring, encoding and mixing."""
