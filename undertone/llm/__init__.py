"""Operators for training-data pipelines: tokens, near duplicates, search, mixing, scoring."""
