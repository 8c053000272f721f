"""Operators of a training-data pipeline (dedup, quality, tokenising, packing, search, extraction)."""
