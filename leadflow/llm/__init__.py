"""Operators for training-data pipelines: search, deduplication, filters, scans and mixing."""
