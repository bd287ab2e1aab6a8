"""Batch operators: joins, aggregates, windows, quality, privacy, models, vectors."""
