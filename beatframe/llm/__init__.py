"""Operators of a training-data pipeline: tokens, near duplicates, search, classifiers, extraction, packing."""
