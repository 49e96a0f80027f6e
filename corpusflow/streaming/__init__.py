"""Structured Streaming over events and progress streams."""
