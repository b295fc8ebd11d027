"""Operators of a training-data pipeline: tokens, packing, near and substring duplicates, quality, extraction, shards."""
