"""Operators of a training-data pipeline: each maps DataFrames to a DataFrame."""
