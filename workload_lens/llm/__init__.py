"""Operators for training data: filters, search, deduplication, models and token files."""
