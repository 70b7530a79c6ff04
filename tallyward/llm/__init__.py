"""Operators of a training-data pipeline: packing, cleaning, scoring, duplicates, extraction, sharding."""
