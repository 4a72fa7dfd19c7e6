"""Operators of a training-data pipeline: dedup, quality, search, PII, archives, mixing and more."""
