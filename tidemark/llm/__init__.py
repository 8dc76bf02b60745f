"""Operators of a training-data pipeline: scans, mixing, search, classification, near-duplicates and tokens."""
