"""Operators of a training-data pipeline: deduplication, cleaning, scoring, mixing, search, tokens."""
