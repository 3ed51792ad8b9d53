"""Operators of a training-data pipeline: filters, deduplication, search, archives and mixing."""
