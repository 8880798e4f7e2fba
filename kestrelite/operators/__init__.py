"""Operators on DataFrames. Each module states its result for nulls, ties, repeated rows and empty input."""
