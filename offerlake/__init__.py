"""Job-offer analytics as DataFrame jobs: payloads to canonical offers, facts, filters, scores, store and matching."""
