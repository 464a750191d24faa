"""Structured Streaming jobs over the append-only edit log."""
