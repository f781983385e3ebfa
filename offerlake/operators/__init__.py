"""Filters, deduplication, scoring, store and matching: DataFrame to DataFrame."""
