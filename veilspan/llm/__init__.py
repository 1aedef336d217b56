"""Operators of a training-data pipeline: dedup, privacy, quality, mixing, sharding, packing."""
