"""Operators of a training-data pipeline: filters, near-duplicates, search, packing, tokens."""
