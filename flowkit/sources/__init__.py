"""Where DataFrames come from."""
