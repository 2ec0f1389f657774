"""Operators for training-data pipelines: tokens, search, safety, duplicates."""
