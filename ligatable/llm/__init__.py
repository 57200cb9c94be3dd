"""Operators for training-data pipelines: filtering, deduplication, mixing, counting."""
