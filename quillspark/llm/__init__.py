"""Operators for preparing training data: deduplication, filtering, mixing and formatting."""
