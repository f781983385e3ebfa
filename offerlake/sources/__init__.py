"""Landed payloads to canonical offers, one adapter for each source."""
