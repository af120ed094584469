"""Operators for training-data pipelines: deduplication, search, mixing, token files, licences, quality, language, packing."""
