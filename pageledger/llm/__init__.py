"""Operators of a training-data pipeline: filtering, deduplication, privacy, formatting, tokenising, packing, search."""
