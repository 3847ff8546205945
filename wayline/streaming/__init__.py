"""Structured Streaming forms of the window features."""
