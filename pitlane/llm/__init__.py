"""Operators for building training corpora: search, tokenising, deduplication, filtering, sharding, extraction."""
