"""Operators for training-data pipelines: filtering, deduplication, mixing, packing, formatting and scoring."""
