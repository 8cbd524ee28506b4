"""Structured Streaming forms of the scoring and audit operators."""
