"""Structured Streaming counterparts of the keyed log operators."""
