"""Operators for large text corpora: scoring, filtering, deduplication, search, sharding and packing."""
