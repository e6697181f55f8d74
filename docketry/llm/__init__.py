"""Operators for preparing training data: filters, deduplication, packing, archives, formatting."""
