"""Streaming of the key-value engine."""
