"""Operators of a training-data pipeline: tokens, packing, duplicates, filters and quality. Nothing else in the library imports them."""
