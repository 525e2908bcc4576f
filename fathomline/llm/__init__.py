"""Operators of a training-data pipeline: dedup, filters, tokens, packing, mixing and exact search over text tables."""
