"""Operators of a training-data pipeline: dedup, extraction, tokens, sampling, archives, search."""
