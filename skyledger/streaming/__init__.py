"""Structured Streaming jobs over the landing folder."""
