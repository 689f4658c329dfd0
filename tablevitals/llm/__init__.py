"""Operators of a training-data pipeline: dedup, sharding, mixing, scoring and encoding of documents."""
