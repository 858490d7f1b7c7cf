"""Operators on DataFrames: rows in, rows out, nothing run."""
