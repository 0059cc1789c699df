"""Operators for preparing training corpora: scoring, search, deduplication, packing, tokenising and archives."""
