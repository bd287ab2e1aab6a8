"""Structured Streaming forms of the event metrics."""
