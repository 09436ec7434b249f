"""Operators on DataFrames: chunks, pairs, generation and metrics."""
