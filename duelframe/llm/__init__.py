"""Operators for training-data pipelines: filters, duplicates, tokens, archives."""
