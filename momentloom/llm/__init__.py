"""Operators of a training-data pipeline: mixing, filtering, deduplication, extraction, archives."""
