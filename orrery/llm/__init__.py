"""Operators of a training-data pipeline: filters, deduplication, decontamination, sharding, packing and scoring."""
