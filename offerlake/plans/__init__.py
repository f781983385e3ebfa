"""Whole plans: the campaign, and the registered queries with their SQL."""
