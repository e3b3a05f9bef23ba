"""Operators for preparing text corpora: extraction, cleaning, deduplication, tokens."""
