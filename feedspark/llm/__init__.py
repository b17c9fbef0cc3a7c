"""Operators of a training-data pipeline: cleaning, dedup, mixing, formatting, sharding and token output."""
