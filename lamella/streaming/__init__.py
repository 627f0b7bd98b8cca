"""Structured Streaming forms of the additive measures."""
