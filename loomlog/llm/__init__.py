"""Operators of a training-data pipeline: near-duplicates, packing, filters, tokenizers."""
