"""Operators: DataFrames in, a DataFrame out, no action inside."""
