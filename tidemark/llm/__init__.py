"""Operators for training-data pipelines: deduplication, filtering, extraction, tokenizing, scoring, mixing, search."""
