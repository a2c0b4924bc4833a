"""Operators of a training-data pipeline: quality, licences, sharding, mixing,
near-duplicates, toxicity, tokenisers, token files and personal data."""
