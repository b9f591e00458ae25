"""Operators of a training-data pipeline: deduplication, tokens, mixing, shards, archives, quality."""
